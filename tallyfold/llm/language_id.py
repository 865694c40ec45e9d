"""Language identification by Bayesian fusion of text, markup and address.

For each row and language, log posterior = tempered text likelihood + likelihood of the
declared language + log prior of the host.

* Text: byte trigrams of the letters, hashed to 2^16 cells, with one smoothed table per
  language from a bounded sample of labelled rows, and a flat table for "none of these"
  (``und``).  The mean per trigram counts as often as there are trigrams, EVIDENCE times
  at most: neighbouring trigrams repeat each other's evidence.
* Declared language: how often rows whose text speaks for a language declare each
  language, counted over all rows.
* Host: counts of what texts speak for by address suffix, domain and host, each level
  smoothed by the one above and the row itself left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, cut, given_back, prepare, slices

CELLS_BITS = 16
#: Labelled rows that the text model is fitted on, about, as many for each language if it has them; most languages, by
#: number of rows (one table each is broadcast); fewest rows of one.
TRAIN_ROWS, MOST_LANGUAGES, LEAST_ROWS = 20_000, 256, 5
SMOOTH = 0.5
EVIDENCE = 300
#: Rows that the level above weighs in a host's prior; pseudo-count of a declaration.
STRENGTH, DECLARED_SMOOTH = 20.0, 1.0
ACCEPTED = 0.5
UND = "und"
BROADCAST_ROWS, SALTS = 200_000, 16

_letters = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    _letters[_b] = _b + 32 if 65 <= _b <= 90 else _b if 97 <= _b <= 122 or _b >= 128 else 32


def trigram_cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all trigrams of all texts in order, and how many each text has."""
    data = _letters[np.frombuffer(b"  " + b"  ".join(texts) + b"   ", dtype=np.uint8)].astype(np.uint32)
    codes = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    # Runs of blanks say nothing.  A trigram belongs to the text that its middle lies in; two blanks part the texts.
    keep = ~((data[1:-1] == 32) & ((data[:-2] == 32) | (data[2:] == 32)))
    middles = np.cumsum([1] + [len(t) + 2 for t in texts])
    counts = np.diff(np.r_[0, np.cumsum(keep)][np.minimum(middles, len(keep))])
    cells = (codes[keep] * np.uint32(2654435761)) >> np.uint32(32 - CELLS_BITS)
    return cells, counts


def _groups(batches, column: int, most: int = 500_000):
    claim(__name__)
    for batch in batches:
        texts = [(x or "").encode() for x in batch.column(column).to_pylist()]
        for a, b in slices([len(x) for x in texts], most):
            yield batch, a, b, texts[a:b]


class TextModel:
    """Log probabilities by cell for each language and, last, for ``und``."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        total = counts.sum(axis=1, keepdims=True)
        smoothed = (counts + SMOOTH) / (total + SMOOTH * counts.shape[1])
        flat = np.full((1, counts.shape[1]), 1.0 / counts.shape[1])
        self.table = np.log(np.vstack([smoothed, flat])).T.astype(np.float32).copy()

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihoods (one row per text) and numbers of trigrams."""
        cells, counts = trigram_cells(texts)
        out = np.zeros((len(texts), self.table.shape[1]))
        some = np.flatnonzero(counts)
        if len(some):
            starts = (np.cumsum(counts) - counts)[some]
            mean = np.add.reduceat(self.table[cells], starts, axis=0, dtype=np.float64) / counts[some, None]
            out[some] = mean * np.minimum(counts[some], EVIDENCE)[:, None]
        return out, counts


def fit_text_model(train: DataFrame, text: str, label: str) -> TextModel:
    """Fit on the labelled rows, or on a sample of about TRAIN_ROWS chosen by hash."""
    train = train.where(F.col(label).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(label).alias("label"))
    prepare(train.sparkSession)
    # Languages: the most frequent labels, a list bounded by MOST_LANGUAGES.
    rows = train.groupBy("label").count().where(F.col("count") >= LEAST_ROWS).orderBy(F.desc("count"), "label").limit(MOST_LANGUAGES).collect()
    languages = sorted(r["label"] for r in rows)
    if not languages:
        return TextModel([], np.zeros((0, 1 << CELLS_BITS)))
    # Each language's share: its part of TRAIN_ROWS, and what others leave goes to those with more rows.
    left, shares = TRAIN_ROWS, {}
    for k, r in enumerate(sorted(rows, key=lambda r: (r["count"], r["label"]))):
        take = min(r["count"], left // (len(rows) - k))
        left, shares[r["label"]] = left - take, int(take / r["count"] * (1 << 20)) + 1
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    drawn = train.where(F.col("label").isin(languages) & (F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 20)) < share[F.col("label")]))

    def counted(batches):
        counts = np.zeros((len(languages), 1 << CELLS_BITS), dtype=np.int64)
        for batch, a, b, texts in _groups(batches, 0):
            labels = batch.column(1).to_pylist()[a:b]
            cells, n = trigram_cells(texts)
            ends = np.cumsum(n)
            for lab, e, k in zip(labels, ends, n):
                counts[languages.index(lab)] += np.bincount(cells[e - k : e], minlength=1 << CELLS_BITS)
        yield from _packed(enumerate(counts))

    def merged(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(data, dtype=np.int64)
        yield from _packed(total.items())

    made = drawn.mapInArrow(counted, "k int, counts binary").withColumn("part", F.spark_partition_id() % 16)
    parts = made.repartition("k", "part").select("k", "counts").mapInArrow(merged, "k int, counts binary").repartition("k").mapInArrow(merged, "k int, counts binary").collect()
    counts = np.zeros((len(languages), 1 << CELLS_BITS))
    for r in parts:  # languages times 2^16 numbers
        counts[r["k"]] += np.frombuffer(bytes(r["counts"]), dtype=np.int64)
    return TextModel(languages, counts)


def _packed(rows):
    for k, counts in rows:
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.asarray(counts, dtype=np.int64).tobytes()], pa.binary())], names=["k", "counts"])


def host_levels(host: Column) -> tuple[Column, Column]:
    """Domain (last two labels) and address suffix (last label) of a host name."""
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def page_host(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.regexp_replace(host, r"\A(www|m)\.", "")


def page_declared(html: Column) -> Column:
    found = F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*?\blang\s*=\s*["']?\s*([A-Za-z]{2,3})""", 1))
    return F.when(found != "", found)


def page_text(html: Column) -> Column:
    """Visible text of a page: no scripts, styles and tags; a few entities read."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(c))
    return text


def _vote(model) -> tuple[T.StructField, T.StructField]:
    return T.StructField("__scores", T.ArrayType(T.FloatType())), T.StructField("__vote", T.IntegerType())


def with_language(
    df: DataFrame, model: TextModel, text: str = "text", declared: str = "lang", host: str = "source", keep_text: bool = True
) -> DataFrame:
    """Columns of ``df`` (less the text if ``keep_text`` is false), then ``language``, ``posterior`` and ``accepted``.

    ``language`` is one of the model's or ``und``; a row is accepted if it is not ``und`` and
    its posterior is ACCEPTED or more.  A text without letters (null, empty, digits and signs
    only) is ``und`` with posterior 1.  A null declared language or host gives no evidence; a
    declared language that the model doesn't know counts as one further kind.  Equal rows get
    equal results.  An empty table gives an empty result.  Columns with the three new names
    are replaced; others stay, whatever their names.
    """
    df = df.drop("language", "posterior", "accepted")
    safe = {c: f"c{k}" for k, c in enumerate(df.columns)}
    out = _with_language(df.toDF(*safe.values()), model, safe[text], safe[declared], safe[host], keep_text)
    return out.select(*[F.col(s).alias(c) for c, s in safe.items() if keep_text or c != text], "language", "posterior", "accepted")


def _with_language(df: DataFrame, model: TextModel, text: str, declared: str, host: str, keep_text: bool) -> DataFrame:
    """The same for columns whose names no step uses."""
    spark = df.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in df.columns if keep_text or c != text]
    n_lang = len(model.languages)

    def scored_batches(batches, place: int, kept: list[int]):
        """The columns ``kept`` (their places), scores and vote of the rows, whose texts are in column ``place``."""
        for batch, a, b, texts in _groups(batches, place):
            scores, n = shared.value.scores(texts)
            vote = np.where((n > 0) & (scores.argmax(axis=1) < n_lang), scores.argmax(axis=1), -1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, scores.size + 1, scores.shape[1]), pa.int32()), pa.array(np.where((n > 0)[:, None], scores, np.nan).ravel().astype(np.float32)))
            own = [batch.schema.names[k] for k in kept]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(a, b - a) for k in kept], flat, pa.array(vote, pa.int32())], names=[*own, *[f.name for f in _vote(model)]])

    def scored(columns: list[str]) -> DataFrame:
        run = given_back(lambda batches: scored_batches(batches, 0, list(range(1, 1 + len(columns)))))
        return df.select(text, *columns).mapInArrow(run, T.StructType([*[df.schema[c] for c in columns], *_vote(model)]))

    # Declarations: 0..n-1 for the model's languages, n for another; counts by vote over all rows.
    known = F.array_position(F.array(*map(F.lit, model.languages)), F.lower(F.col(declared))) if n_lang else F.lit(0)
    code = F.when(F.col(declared).isNull(), None).when(known > 0, known - 1).otherwise(n_lang).cast("int")
    coded = {"__declared": code, "__host": F.col(host).cast("string")}
    if keep_text:  # texts are scored again where evidence is fused: no table of them is written, and no two Python steps follow each other
        rows, first = df.withColumns(coded), scored(list(dict.fromkeys([declared, host]))).withColumns(coded)
    else:
        rows = first = cut(scored(names), "language-scores").withColumns(coded)
    votes = first.where("__vote >= 0").groupBy("__host", "__declared", "__vote").agg(F.count("*").alias("n"))
    votes = cut(votes, "language-votes")
    said = np.full((n_lang, n_lang + 1), DECLARED_SMOOTH)
    for r in votes.where("__declared IS NOT NULL").groupBy("__declared", "__vote").agg(F.sum("n").alias("n")).collect():  # languages squared
        said[r["__vote"], r["__declared"]] += r["n"]
    overall = np.ones(n_lang)
    for r in votes.groupBy("__vote").agg(F.sum("n").alias("n")).collect():
        overall[r["__vote"]] += r["n"]

    def counts(by: list[str], name: str) -> DataFrame:
        each = F.array(*[F.sum(F.when(F.col("__vote") == k, F.col("n")).otherwise(0)) for k in range(n_lang)])
        return levels.groupBy(*by).agg(each.alias(name))

    domain, suffix = host_levels(F.col("__host"))
    levels = votes.where("__host IS NOT NULL").withColumns({"__domain": domain, "__suffix": suffix})
    if n_lang:
        hosts = counts(["__host", "__domain", "__suffix"], "__h").join(counts(["__domain"], "__d"), "__domain").join(counts(["__suffix"], "__s"), "__suffix")
        hosts = cut(hosts.select("__host", "__h", "__d", "__s"), "hosts")
        if hosts.count() <= BROADCAST_ROWS:
            joined = rows.join(F.broadcast(hosts), "__host", "left")
        else:  # a host with very many rows is spread over SALTS keys
            salted = hosts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            joined = rows.withColumn("__salt", F.floor(F.rand(1) * SALTS).cast("int")).join(salted, ["__host", "__salt"], "left")
    else:
        joined = rows.withColumns({c: F.lit(None).cast("array<long>") for c in ("__h", "__d", "__s")})

    evidence = spark.sparkContext.broadcast((np.log(said / said.sum(axis=1, keepdims=True)), overall / overall.sum()))
    out_schema = T.StructType([*[df.schema[c] for c in names], T.StructField("language", T.StringType()), T.StructField("posterior", T.DoubleType())])
    known_of, found = ["__declared", "__h", "__d", "__s"], [f.name for f in _vote(model)]
    extra = [*known_of, *found]

    def fused(batches):
        log_said, base = evidence.value
        languages = [*model_languages, UND]
        for batch in batches:
            rows = batch.num_rows
            said_code, *counts, scores, vote = [batch.column(len(names) + k) for k in range(len(extra))]
            log = np.array(scores.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(rows, n_lang + 1)
            silent = np.isnan(log[:, 0])
            vote = vote.to_numpy(zero_copy_only=False)
            own = np.zeros((rows, n_lang))
            own[np.flatnonzero(vote >= 0), vote[vote >= 0]] = 1  # leave the row itself out of its host's counts
            prior = np.tile(base, (rows, 1))
            for c in (counts[2], counts[1], counts[0]):  # suffix, domain, host
                there = np.array(c.is_valid())
                seen = np.zeros((rows, n_lang))
                if there.any():
                    seen[there] = np.array(c.drop_null().flatten()).reshape(-1, n_lang)
                seen = np.maximum(seen - own, 0)
                prior = np.where(there[:, None], (seen + STRENGTH * prior) / (seen.sum(axis=1, keepdims=True) + STRENGTH), prior)
            log[:, :n_lang] += np.log(prior)
            log[:, n_lang] += np.log(1 / (n_lang + 1))
            d = np.array([-1 if x is None else x for x in said_code.to_pylist()])
            spoken = np.flatnonzero(d >= 0)
            log[spoken, :n_lang] += log_said[:, d[spoken]].T
            log[spoken, n_lang] += np.log(1 / (n_lang + 1))
            log -= log.max(axis=1, keepdims=True, initial=-np.inf)
            p = np.exp(log)
            p /= p.sum(axis=1, keepdims=True)
            best = np.where(silent, n_lang, np.nan_to_num(p).argmax(axis=1))
            sure = np.where(silent, 1.0, p[np.arange(rows), best])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([languages[k] for k in best], pa.string()), pa.array(sure)], names=out_schema.names)

    model_languages = list(model.languages)
    if keep_text:
        taken = [*names, *known_of]
        run = given_back(lambda batches: fused(scored_batches(batches, names.index(text), list(range(len(taken))))))
        out = joined.select(*taken).mapInArrow(run, out_schema)
    else:
        out = joined.select(*names, *extra).mapInArrow(given_back(fused), out_schema)
    return out.withColumn("accepted", (F.col("language") != UND) & (F.col("posterior") >= ACCEPTED))


def identified(docs: DataFrame, text: str = "text", label: str = "lang", host: str = "source", keep_text: bool = True) -> DataFrame:
    """with_language under a model fitted on the rows' own labels, which also count as declarations."""
    return with_language(docs, fit_text_model(docs, text, label), text, label, host, keep_text)
