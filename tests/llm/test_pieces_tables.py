"""The bounded tables of op 4: segments that come again survive a turn of the table, verdicts a full one."""

from timeweave.llm import sentence_pieces


def test_common_segments_are_encoded_once(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 8)
    pieces, met = sentence_pieces.Pieces(sentence_pieces.load_model()), []
    plain = pieces.viterbi
    monkeypatch.setattr(pieces, "viterbi", lambda segments: met.extend(segments) or plain(segments))
    for i in range(12):
        pieces.encode([f"common words {i}a {i}b"])
        assert len(pieces.remembered) + len(pieces.older) <= 8
    assert met.count("▁common") == met.count("▁words") == 1 and len(met) == 26


def test_verdicts_in_few_slots(monkeypatch):
    import sentencepiece

    texts = ["The quick brown fox, naïve café 12345 über", "reencoding intermediates; antidisestablishmentarianism", "zzz \t\n  日本語 x"]
    monkeypatch.setattr(sentence_pieces, "VERDICTS", 16)
    pieces = sentence_pieces.Pieces(sentence_pieces.load_model())
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL_PATH)
    for _ in range(2):
        assert [ids.tolist() for ids in pieces.encode(texts)] == [library.encode(text) for text in texts]
        pieces.remembered, pieces.older = {}, {}
