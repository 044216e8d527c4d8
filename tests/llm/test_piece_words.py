"""What a worker of the SentencePiece codec remembers has a limit, and the limit changes no ids."""

import public_tokenizers

from markwright.llm import piece_codec

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_words_have_a_limit(monkeypatch):
    monkeypatch.setattr(piece_codec, "WORDS", 100)
    codec, stream = piece_codec.Codec(PIECES), piece_codec.StreamingViterbi(piece_codec.Vocabulary(PIECES))
    texts = [" ".join(f"w{i % 700}x" for i in range(2000)), "ab " + "zq" * 5000 + " é漢 \U0001f600", *["a" * n + " b" for n in (62, 63, 64, 65)]]
    for text in texts:
        ids = stream.push(piece_codec.BLANK + text.replace(" ", piece_codec.BLANK)) + stream.finish()
        assert codec.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert len(codec.words) <= 100 and max(map(len, codec.words)) < piece_codec.SHORT


def test_texts_stay_behind(spark):
    coded = piece_codec.encode(spark.createDataFrame([(1, "some text", "x"), (2, None, "y")], "doc_id long, text string, lang string"), PIECES, text=False)
    assert coded.columns == ["doc_id", "lang", "ids", "n_tokens", "round_trip"]
    assert {(r.doc_id, r.lang, r.n_tokens > 0, r.round_trip) for r in coded.collect()} == {(1, "x", True, True), (2, "y", False, True)}
