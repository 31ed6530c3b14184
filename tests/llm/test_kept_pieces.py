"""When a worker keeps too much, the pieces asked again are not encoded again."""

from momentsift.llm import vocab
from momentsift.llm.tokencount import tokenizer_path


def test_common_pieces_outlive_forgetting(monkeypatch):
    monkeypatch.setattr(vocab, "KEPT_BYTES", 1)
    for lengths_only in (False, True):
        pieces, asked = vocab.Pieces(tokenizer_path("word_bpe_49k.json"), lengths_only), []
        encode = pieces._encode
        monkeypatch.setattr(pieces, "_encode", lambda some, f=encode: asked.append(sorted(some)) or f(some))
        for group in (["common", "once"], ["common", "other"], ["common", "once"]):
            pieces.learn([group])
            assert set(group) == set(pieces) and pieces.kept == sum(map(pieces._bytes, pieces.items()))
        assert asked == [["common", "once"], ["other"], ["once"]]
