"""Quality classifier and language identification: byte convolutional networks (see byteconv).

Both are fitted on the driver in numpy on a bounded sample of labelled rows and
score whole texts on the executors.  The network's weights (about 100 kB) travel
with the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .byteconv import ConvNet
from .common import map_arrow
from .words import string_buffers

#: Labelled rows the quality network is fitted on, at most; those with the least hash of doc_id.
QUALITY_ROWS = 4000
#: Rows per language that the language network is fitted on, at most, and how many languages, the most frequent ones.
LANGUAGE_ROWS, LANGUAGES = 500, 100
#: Bytes of a text that is learned from, and of all of them, at most: longer ones are scored like any other, but not learned from.
TEXT_BYTES, SAMPLE_BYTES = 1 << 16, 1 << 25
#: How many times the rows wanted a first sieve by hash lets through.
SPARE = 8
#: A text is predicted to be good from this score on.
ACCEPT = 0.7
#: Texts scored at once.
GROUP_BYTES = 1 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _packed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = string_buffers(pa.array(texts, pa.large_string()))
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _probabilities(net: ConvNet, texts: pa.Array) -> np.ndarray:
    """Class probabilities of a batch, some texts at a time, each whole."""
    data, offsets = string_buffers(texts)
    out, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, "right")) - 1)
        own = offsets[at : to + 1]
        out.append(net.probabilities(data[own[0] : own[-1]], own - own[0]))
        at = to
    return np.concatenate(out)


def _least(rows: DataFrame, wanted: int, of: Column) -> DataFrame:
    """A sieve: of about ``of`` rows SPARE times the wanted number, those with the least hash of doc_id."""
    share = F.least(F.lit(1.0), F.lit(float(SPARE * wanted)) / of)
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))


def _sample(documents: DataFrame, chosen: DataFrame) -> list:
    """(doc_id, y, text) of the chosen (doc_id, y), a bounded number of rows, so that they may be broadcast.

    Of the rows of one id the least text counts; null texts and those over TEXT_BYTES are left out, as is what comes
    (in the order of hashed ids) when SAMPLE_BYTES are reached.
    """
    texts = documents.select("doc_id", "text").where(F.octet_length("text") <= TEXT_BYTES).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "y"))
    got = one.withColumn("__bytes", so_far).where(F.col("__bytes") <= SAMPLE_BYTES).select("doc_id", "y", "text").collect()
    return sorted(got, key=lambda r: (r.doc_id, r.text, str(r.y)))


def fit_quality(documents: DataFrame, labels: DataFrame, rows: int = QUALITY_ROWS) -> ConvNet | float:
    """A network for P(quality = 1), from labelled rows that are not held out.

    With labels of one kind only, that kind's constant score; without any, 1.0.
    """
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out()).distinct()
    chosen = _least(usable, rows, F.lit(max(1, usable.count()))).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    got = _sample(documents, chosen)
    y = np.array([r.y for r in got], np.int64)
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 1.0
    net = ConvNet.random(widths=(4,), filters=24, hidden=16, classes=2, blocks=8, step=7, per_chunk=False, seed=1)
    return net.fit(*_packed([r.text for r in got]), y, epochs=10, batch=32, rate=0.01, seed=2)


def quality_scores(df: DataFrame, model: ConvNet | float, text: str = "text", score: str = "score") -> DataFrame:
    """``df`` with a column ``score`` in 0 to 1, from whole texts; a null text scores as an empty one.

    A column of that name is replaced.  Repeated rows score alike.
    """
    df = df.drop(score) if score in df.columns else df
    schema = T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType())])
    if isinstance(model, float):
        return df.withColumn(score, F.lit(model))
    model.bank.pairs = []

    def make():
        model.bank.compiled()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = _probabilities(model, batch.column(text))[:, 1].astype(float)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, score])

        return apply

    return map_arrow(df, make, schema)


def fit_language(documents: DataFrame, rows_per_language: int = LANGUAGE_ROWS) -> tuple[list[str], ConvNet | None]:
    """Languages and a network over them, from rows with text and language that are not held out."""
    usable = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("lang").alias("y"))
    counts = usable.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(LANGUAGES)
    counts = documents.sparkSession.createDataFrame(counts.collect(), counts.schema)
    some = _least(usable.join(F.broadcast(counts), "y"), rows_per_language, F.col("n")).select("doc_id", "y").distinct()
    w = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = some.withColumn("k", F.row_number().over(w)).where(F.col("k") <= rows_per_language).drop("k")
    got = _sample(documents, chosen)
    languages = sorted({r.y for r in got})
    if not got:
        return [], None
    net = ConvNet.random(widths=(2, 3, 4), filters=8, hidden=16, classes=len(languages), blocks=8, step=8, per_chunk=True, seed=1)
    return languages, net.fit(*_packed([r.text for r in got]), np.array([languages.index(r.y) for r in got]), epochs=6, batch=32, rate=0.01, seed=2)


def predict_language(df: DataFrame, model: tuple[list[str], ConvNet | None], text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the likeliest language and its probability, the mean over a text's 256-byte windows.

    ``und`` with score 0 if the text is null or has no letter, or if no language was learned.
    Columns of these names are replaced.
    """
    df = df.drop(*[c for c in (lang, score) if c in df.columns])
    schema = T.StructType([*df.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    languages, net = model
    if net is None:
        return df.withColumn(lang, F.lit("und")).withColumn(score, F.lit(0.0))
    net.bank.pairs = []

    def make():
        net.bank.compiled()
        names = np.array(languages, object)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(text)
            p = _probabilities(net, texts)
            some = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
            best = np.where(some, names[p.argmax(1)], "und")
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(np.where(some, p.max(1), 0.0).astype(float))], [*batch.schema.names, lang, score])

        return apply

    return map_arrow(df, make, schema)
