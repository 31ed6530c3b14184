"""Pieces that the library encodes many in one text have the ids that they have alone, in far fewer texts."""

import numpy as np
from momentsift.llm import vocab
from momentsift.llm.tokencount import tokenizer_path


def test_whole_pieces_share_texts_and_keep_their_ids(monkeypatch):
    path = tokenizer_path("word_bpe_49k.json")
    odd = ["0", "'s", "''", "</", "w", ">", "</w>", "<|", "<|endoftext|>", "\x01", "\x7f", "\xad", "µ", "ß", "ÿ", "ª", "Ünder", "'S", "l'été", "ａ０", "中文。字", "é", "x　y", "\x0b", "ΣΑΣ", "İ", "\u2003", "\u0301"]
    pieces = list(dict.fromkeys([*odd, *map(chr, range(33, 127)), *(f"w{'abcdefghij'[k % 10]}{'éöxyz'[k % 5]}" * (k % 7 + 1) for k in range(900))]))
    for lengths_only in (False, True):
        own, texts = vocab.Pieces(path, lengths_only), []
        ids = own._ids
        monkeypatch.setattr(own, "_ids", lambda some, f=ids: texts.extend(some) or f(some))
        own.learn([pieces])
        alone = {p: own.tokenizer.encode(p, add_special_tokens=False).ids for p in pieces}
        assert dict(own) == {p: len(i) if lengths_only else np.array(i, "<u4").tobytes() for p, i in alone.items()}
        assert own.kept == sum(map(own._bytes, own.items()))
        assert len(texts) < 40


def test_words_whose_end_has_no_id_are_encoded_alone():
    own = vocab.Pieces(tokenizer_path("word_bpe_49k.json"), False)
    own.ends[own.tokenizer.encode("one", add_special_tokens=False).ids] = False
    own.learn([["one", "two", "three"]])
    assert dict(own) == {p: np.array(own.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in ("one", "two", "three")}
