"""What is remembered of pieces: frequent ones stay, within the bound."""

from quarrymind.functions import bpe


def test_frequent_pieces_are_merged_once(monkeypatch):
    made, inner = [], bpe.merged
    monkeypatch.setattr(bpe, "REMEMBER", 6000)
    monkeypatch.setattr(bpe, "merged", lambda piece, ranks: made.append(piece) or inner(piece, ranks))
    own = bpe.Pieces({bytes([i]): i for i in range(256)} | {b"ab": 256, b" a": 257}, bpe.PATTERN)
    for i in range(300):
        assert own.count(f"often n{i}") == len("often") + 2 + len(str(i))
    assert made.count(b"often") == 1 and len(own.counts) + len(own.counts.older) < 60
