"""Quality classifier: interpolated modified Kneser-Ney over character n-grams (operator 1).

The model is trained on trusted text. Counts of the highest order are raw, those of
lower orders are continuation counts; each order has the three discounts of its
counts of counts; probabilities interpolate down to a uniform base. Tables stay
sharded by n-gram: tasks sum their n-grams first, and every step is a
join or aggregation on the n-gram.

Scoring joins counts with documents without moving texts: each block (at most
about ``CHUNK`` bytes of a scan task's texts, or one longer text) asks once for its distinct n-grams, the
requests join the sharded tables order by order, and the answers return to the
block as one sorted array in the shared folder. Perplexity is exp of the mean negative log
probability per character; a document is kept when it is at most the
``quantile`` of its language's trusted documents that the model wasn't trained
on (every fourth by the checksum of its id), as a model fits its own
training texts too well to set limits by them.

``docs`` is a scan of stored files, so both passes see the same blocks; a block
that misses an answer raises. White space, NUL and STX (which pads the texts) count
as blanks, and those at a text's ends don't count. Null and blank texts have no
characters: perplexity null and rejected. A null lang is a language of its own; a language without
such documents takes the quantile of all languages; without any, all
scored documents are kept; without trusted text, all perplexities are null and all documents are kept. A null doc_id
is scored and never trusted; repeated ids give a row each. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks as runs_of
from .common import filesystem, remembered, rows_a_batch, shared_path, utf8, written
from .textops import mix

ORDER = 5
HELD = 3_000_000  # distinct n-grams a training task holds before it emits them
CHUNK = 1 << 26  # bytes of text that ask for their n-grams together
PIECE = 1 << 18  # bytes of text whose windows a task holds at a time
ROWS = 1000  # rows of an Arrow batch
BROADCAST_IDS = 2_000_000
START = "\x02"
_BLANKS = " \t\n\v\f\r\x00" + START


def _windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of the n-gram that ends in each character, characters per text, code points of the padded texts)."""
    own = [(t or "").strip(_BLANKS) for t in texts]
    pad = START * (ORDER - 1)
    code = pad.join(["", *own])
    if "\x00" in code or code.count(START) > len(pad) * len(own):
        own = [t.replace("\x00", " ").replace(START, " ") for t in own]
        code = pad.join(["", *own])
    size = np.array([len(t) for t in own], np.int64)
    first = np.cumsum(size + ORDER - 1) - size - (ORDER - 1)
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    c = np.frombuffer(code.encode("utf-32-le", "surrogatepass"), np.uint32)
    return at, size, np.where((c >= 9) & (c <= 13), np.uint32(32), c)


def _keys(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams that start at ``at``."""
    c = code.astype(np.uint64)
    n = len(c) - ORDER + 1
    key = c[:n].copy()
    for k in range(1, ORDER):
        key *= np.uint64(0x2545F4914F6CDD1D)
        key += c[k : k + n]
    return mix(key[at])


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order of appearance, place of each value among them), by hashing."""
    found = pa.array(key.view(np.int64)).dictionary_encode()
    return found.dictionary.to_numpy().view(np.uint64), found.indices.to_numpy()


class Distinct:
    """Distinct n-grams of the texts added so far: hash, characters, number."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.key, self.names, self.cnt = np.zeros(0, np.uint64), np.zeros(0, f"<U{ORDER}"), np.zeros(0, np.int64)  # sorted by key
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_new = 0

    def __len__(self) -> int:
        return len(self.key) + self.n_new

    def add(self, code: np.ndarray, at: np.ndarray) -> None:
        key, place = _distinct(_keys(code, at))
        cnt = np.bincount(place)
        where = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        known = self.key[where] == key if len(self.key) else np.zeros(len(key), bool)
        self.cnt[where[known]] += cnt[known]
        first = at[np.flatnonzero(np.diff(np.maximum.accumulate(place), prepend=-1))][~known]
        names = np.ascontiguousarray(code[first[:, None] + np.arange(ORDER)]).view(f"<U{ORDER}").ravel()
        self.new.append((key[~known], names, cnt[~known]))
        self.n_new += len(first)
        if self.n_new > 300_000:
            self.merge()

    def merge(self) -> None:
        if self.n_new:
            key, names, cnt = (np.concatenate(x) for x in zip(*self.new, strict=True))
            own, first, place = np.unique(key, return_index=True, return_inverse=True)
            key, names, cnt = np.concatenate([self.key, own]), np.concatenate([self.names, names[first]]), np.concatenate([self.cnt, np.bincount(place, cnt).astype(np.int64)])
            order = np.argsort(key, kind="stable")
            self.key, self.names, self.cnt = key[order], names[order], cnt[order]
        self.new, self.n_new = [], 0

    def tables(self, block: int) -> Iterator[pa.RecordBatch]:
        """The n-grams in batches; none are held afterwards."""
        self.merge()
        for i in range(0, len(self.key), 20_000):
            key, names, cnt = (x[i : i + 20_000] for x in (self.key, self.names, self.cnt))
            yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(key), block, np.int64)), "key": pa.array(key.view(np.int64)), "gram": pa.array(names, pa.string()), "cnt": pa.array(cnt)})
        self.clear()


def _pieces(parts) -> Iterator[tuple[pa.RecordBatch, int, int, int, list[str | None]]]:
    """(batch, i, j, block, texts i to j) of a task's rows in turn: a new block after every ``CHUNK`` bytes, the same in each pass over the same rows."""
    from pyspark import TaskContext

    base, seen = TaskContext.get().partitionId() << 24, 0
    for batch in parts:
        column = batch.column("text")
        _, off = utf8(column)
        for i, j in runs_of(off, PIECE):
            yield batch, i, j, base + seen // CHUNK, column.slice(i, j - i).to_pylist()
            seen += int(off[j] - off[i])


def _grams(counted: bool):
    """Distinct n-grams, their hash, their characters and number: of a task's texts for training, else of each block of them."""

    def run(parts):
        remembered("kneser_ney")
        held, block = Distinct(), 0
        for _, _, _, now, texts in _pieces(parts):
            if now != block and not counted or len(held) > HELD and counted:
                yield from held.tables(block)
            block = now
            at, _, code = _windows(texts)
            if len(at):
                held.add(code, at)
        yield from held.tables(block)

    return run


GRAMS = "block long, key long, gram string, cnt long"


class Model:
    """For each order n a table (gram, p, logged?) and one (context, gamma); all sharded tables."""

    def __init__(self, probability: dict[int, DataFrame], back_off: dict[int, DataFrame], floor: float):
        self.probability, self.back_off, self.floor = probability, back_off, floor


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; without enough of them the usual 0.5, 1, 1.5."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.01), k + 0.99) for k, x in enumerate(d))


def train(texts: DataFrame) -> Model:
    """Fit on the column ``text`` of all rows."""
    counts = {ORDER: written(texts.mapInArrow(_grams(True), GRAMS).groupBy("gram").agg(F.sum("cnt").alias("c")), "kn-counts")}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = written(counts[n + 1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("c")), f"kn-counts-{n}")
    letters = counts[1].count()
    floor = 1.0 / (letters + 1)
    probability, back_off = {}, {}
    below = None
    for n in range(1, ORDER + 1):
        r = counts[n].agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(1, 5)]).first()
        d = discounts(*r)
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        table = counts[n].withColumn("d", cut).withColumn("context", F.substring("gram", 1, n - 1))
        gamma = written(table.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma")), f"kn-gamma-{n}")
        own = table.join(gamma, "context").select("gram", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"), "gamma")
        if n == 1:
            p = own.select("gram", (F.col("own") + F.col("gamma") * floor).alias("p"))
        else:
            lower = below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            p = own.withColumn("suffix", F.substring("gram", 2, n - 1)).join(lower, "suffix").select("gram", (F.col("own") + F.col("gamma") * F.col("lower")).alias("p"))
        below = probability[n] = written(p, f"kn-p-{n}")
        back_off[n] = gamma.select("context", "gamma")
    return Model(probability, back_off, floor)


def resolve(model: Model, grams: DataFrame, n: int = ORDER) -> DataFrame:
    """(gram, p) of distinct n-grams, seen or not: unseen ones back off to shorter ones, joined order by order."""
    if n == 0:
        return grams.select("gram", F.lit(model.floor).alias("p"))
    both = written(grams.join(model.probability[n], "gram", "left"), f"kn-asked-{n}")
    seen = both.where("p is not null")
    rest = both.where("p is null").select("gram", F.substring("gram", 1, n - 1).alias("context"), F.substring("gram", 2, n - 1).alias("suffix") if n > 1 else F.lit("").alias("suffix"))
    rest = rest.join(model.back_off[n], "context", "left")
    lower = resolve(model, rest.select(F.col("suffix").alias("gram")).distinct(), n - 1).select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
    return seen.select("gram", "p").union(rest.join(lower, "suffix").select("gram", (F.coalesce("gamma", F.lit(1.0)) * F.col("lower")).alias("p")))


def _packed(table: pa.Table) -> pa.Table:
    key = np.concatenate([c.to_numpy(zero_copy_only=False) for c in table.column("key").chunks]).view(np.uint64)
    logp = np.concatenate([c.to_numpy(zero_copy_only=False) for c in table.column("logp").chunks]).astype(np.float64)
    order = np.argsort(key)
    return pa.table({"block": table.column("block").slice(0, 1), "data": pa.array([key[order].tobytes() + logp[order].tobytes()], pa.binary())})


def perplexity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_scored (characters), perplexity of each row of ``docs`` (doc_id, text, lang)."""
    spark = docs.sparkSession
    asked = written(docs.select("doc_id", "text", "lang").mapInArrow(_grams(False), GRAMS).select("block", "key", "gram"), "kn-requests")
    each = written(asked.groupBy("key").agg(F.first("gram").alias("gram")), "kn-distinct")
    known = each.join(resolve(model, each.select("gram")), "gram").select("key", F.ln("p").alias("logp"))
    answers = asked.select("block", "key").join(known, "key").select("block", "key", "logp")
    folder = shared_path(spark, "kn-answers")
    packed = answers.groupBy("block").applyInArrow(_packed, "block long, data binary")

    def store(parts):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        for batch in parts:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                temp = f"{base}/.{block}-{np.random.default_rng().integers(2**62)}"
                with fs.open_output_stream(temp, compression=None) as f:
                    f.write(data.as_buffer())
                fs.move(temp, f"{base}/{block}")  # a retried task replaces the file by an equal one
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64())], ["block"])

    packed.mapInArrow(store, "block long").agg(F.count("*")).collect()

    def score(parts):
        remembered("kneser_ney")
        fs, base = filesystem(folder)
        block, key, logp = -1, None, None
        for batch, i, j, now, texts in _pieces(parts):
            at, size, code = _windows(texts)
            total = np.zeros(len(texts))
            if len(at):
                if now != block:
                    with fs.open_input_file(f"{base}/{now}") as f:
                        raw = f.read()
                    block, key, logp = now, np.frombuffer(raw, np.uint64, len(raw) // 16), np.frombuffer(raw, np.float64, len(raw) // 16, len(raw) // 2)
                want, each = _distinct(_keys(code, at))
                place = np.minimum(np.searchsorted(key, want), len(key) - 1)
                if not (key[place] == want).all():
                    raise RuntimeError("a block of the second pass differs from the first: documents must be a scan of stored files")
                bound = np.concatenate([[0], np.cumsum(logp[place][each])])
                ends = np.cumsum(size)
                total = bound[ends] - bound[ends - size]
            rows = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("lang"), pa.array(size), pa.array(np.exp(-total / np.maximum(size, 1)), mask=size == 0)], ["doc_id", "lang", "n_scored", "perplexity"]
            )

    return docs.select("doc_id", "text", "lang").mapInArrow(score, "doc_id long, lang string, n_scored long, perplexity double")


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = 0.99) -> DataFrame:
    """doc_id, lang, n_scored, perplexity, threshold, kept for each row of ``docs`` (doc_id, text, lang); ``trusted`` has the ids of trusted documents."""
    ids = written(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "trusted")
    few = ids.count() <= BROADCAST_IDS
    base = docs.select("doc_id", "text", "lang")
    aside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    fit = ids.where(~aside)
    text = base.where("text is not null").join(F.broadcast(fit) if few else fit, "doc_id", "left_semi").select("text")
    if text.isEmpty():
        none = F.lit(None).cast("double")
        return base.select("doc_id", "lang", F.lit(0).cast("long").alias("n_scored"), none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("kept"))
    with rows_a_batch(docs.sparkSession, ROWS):
        scored = written(perplexity(base, train(text)), "perplexities")
    good = scored.where("perplexity is not null").join(ids.where(aside), "doc_id", "left_semi")
    at = lambda: F.percentile_approx("perplexity", F.lit(quantile), F.lit(10000))
    own = good.groupBy("lang").agg(at().alias("own")).withColumnRenamed("lang", "l")  # one row a language
    every = good.agg(at()).first()[0]
    both = scored.join(F.broadcast(own), F.expr("lang <=> l"), "left")
    limit = F.coalesce("own", F.lit(every).cast("double"), F.lit(float("inf")))
    return both.select("doc_id", "lang", "n_scored", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("kept"))
