"""Token ids against the library, on texts that its pre-tokeniser treats in odd ways."""

import random

import numpy as np
import public_tokenizers

from markwright.llm import token_files

BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["\u00a0", "\u3000", "\u2009", "\u0085", "\r", "\n", "\t", "\x1c", "\u180e", "\u200b", " ", "  ", "<|endoftext|>", "'s", "'", "é", "日本", "x" * 40, "12", "...", "\u0301", "Ġ"]


def test_ids_equal_the_library_on_random_texts():
    enc = token_files.Encoder(BYTES)
    rng = random.Random(7)
    texts = ["<|endoftext|> foo", "a <|endoftext|> b", ". \xa0 \xa0 baa", "end ", " start", "a\n b", "a \nb", "", "\n", "foo bar\n"]
    for _ in range(20_000):
        texts.append("".join(rng.choice((" ", " ", rng.choice(ODD), rng.choice(("word", "ba", "Tree", "of,")))) for _ in range(rng.randrange(1, 14))))
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        want = [x.ids for x in enc.tok.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(part)] == want


def test_long_text_and_clashing_columns(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTES)
    texts = [" ".join(f"w{i % 977} é{i}" for i in range(60_000)), "plain"]
    rows = spark.createDataFrame([(4, texts[0], 1, 2, "x"), (2, texts[1], 3, 4, "y")], "doc_id long, text string, start long, n_tokens long, ids_crc32 string")
    got = token_files.boundaries(rows, BYTES).orderBy("start").collect()
    sizes = [len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(2, 0, sizes[1]), (4, sizes[1], sizes[0])]
