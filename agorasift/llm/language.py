"""Language identification by Bayesian fusion of text, markup, address and host."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from agorasift.llm.arrow import map_texts
from agorasift.llm.storage import fresh, row_key, stored, tidy

SAMPLE = 20_000  # labelled texts of each language that the text model counts, about; all where there are fewer
LANGUAGES = 200  # labels that make a known language, the most frequent ones; bounds the text model
CELLS = 1 << 16  # of the table of hashed strings of three bytes
GRAMS_AT_ONCE = 1 << 20
SMOOTHING = 0.05  # added to the count of each cell
TEMPER = 0.25  # neighbouring strings overlap; their evidence is not independent
SPREADS = 2.0  # by which a text's mean may lie below that of its language, in standard deviations of one string
UNIFORM_TIMES = 2.0  # a string of a known language is so many times likelier than a uniform draw of a cell, at least
UNKNOWN_PRIOR = 1e-3  # of an unlisted language, against a known one
PRIOR_WEIGHT = 5.0  # observations that the level above is worth
UNKNOWN = "und"


def gram_cells(text: bytes) -> Iterator[np.ndarray]:
    """Cells of all strings of three bytes with a letter in the middle, A-Z lower-cased and blanks at both ends, in parts."""
    data = np.frombuffer(b" " + text.lower() + b" ", np.uint8)
    for at in range(0, max(0, len(data) - 2), GRAMS_AT_ONCE):
        part = data[at: at + GRAMS_AT_ONCE + 2].astype(np.uint32)
        middle = part[1:-1]
        letter = ((middle >= 97) & (middle <= 122)) | (middle >= 0x80)
        codes = (part[:-2] << 16 | middle << 8 | part[2:])[letter]
        yield (codes * np.uint32(0x9E3779B1)) >> np.uint32(16)


@dataclass(frozen=True)
class TextModel:
    """Log-probability of each cell in each language, (cells, languages), and the mean below which a text is in none."""

    languages: tuple[str, ...]
    table: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of_counts(cls, languages: Sequence[str], counts: np.ndarray) -> TextModel:
        """Probabilities of counted cells; bounds from what each counted string has without itself."""
        n, cells = counts.sum(0), len(counts)
        table = np.log((counts + SMOOTHING) / (n + SMOOTHING * cells))
        left = np.log((np.maximum(counts - 1, 0) + SMOOTHING) / (np.maximum(n - 1, 0) + SMOOTHING * cells))
        share = counts / np.maximum(n, 1)
        mean = (share * left).sum(0)
        spread = np.sqrt((share * (left - mean) ** 2).sum(0))
        bounds = np.maximum(mean - SPREADS * spread, np.log(UNIFORM_TIMES / cells))
        return cls(tuple(languages), table.astype(np.float32), bounds)

    def evidence(self, text: bytes) -> tuple[list[float] | None, float | None]:
        """Tempered log-likelihood of the whole text per language, and for none of them; none without letters.

        All are relative to the likeliest language.  An unlisted language makes
        strings as likely as the bound of that language.
        """
        total, n = np.zeros(len(self.languages)), 0
        for cells in gram_cells(text):
            total += np.bincount(cells, minlength=CELLS) @ self.table if len(cells) > CELLS else self.table[cells].sum(0, dtype=float)
            n += len(cells)
        if not n:
            return None, None
        best = int(total.argmax())
        none = float(np.log(UNKNOWN_PRIOR) + TEMPER * (n * self.bounds[best] - total[best]))
        return (TEMPER * (total - total[best])).tolist(), none


def train(docs: DataFrame, label: str = "lang", most: int = SAMPLE) -> TextModel:
    """Counts over about ``most`` labelled texts of each language, or all where there are fewer.

    A text is counted if the hash of its row lies below its language's
    cut-off, ``most`` in so many as the language has, so the sample is the same on
    every run and is taken inside the scan: no text is shuffled.  Every label
    makes a known language, up to the ``LANGUAGES`` most frequent; one with few texts is smoothed,
    not dropped.  Counting is a grouped aggregate; the driver gets one table of
    fixed size per language.
    """
    labelled = docs.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("language")).agg(F.count(F.lit(1)).alias("rows"))
    sizes = {r["language"]: r["rows"] for r in labelled.orderBy(F.desc("rows"), "language").limit(LANGUAGES).collect()}
    known = sorted(sizes)
    if not known:
        return TextModel.of_counts([], np.zeros((CELLS, 0)))
    ends = {name: min((most << 64) // rows, (1 << 64) - 1) - (1 << 63) for name, rows in sizes.items()}
    cut = F.create_map(*[F.lit(x) for name in known for x in (name, ends[name])])
    sample = docs.select(F.col(label).alias("language"), "doc_id", "text").where(
        F.xxhash64("doc_id", "text") <= F.try_element_at(cut, F.col("language")))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {name: np.zeros(CELLS, np.int64) for name in known}
        for batch in batches:
            for name, text in zip(batch.column("language").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                for cells in gram_cells(text.as_py() or b""):
                    sums[name] += np.bincount(cells, minlength=CELLS)
        for name, counts in sums.items():
            cells = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(counts[cells], pa.int64())],
                ["language", "cell", "n"])

    counted = sample.select("language", "text").mapInArrow(work, "language string, cell int, n long")
    table = np.zeros((CELLS, len(known)))
    for row in counted.groupBy("language", "cell").agg(F.sum("n").alias("n")).collect():
        table[row["cell"], known.index(row["language"])] = row["n"]
    return TextModel.of_counts(known, table)


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, doc_id, host, declared) of web pages whose address names a document.

    ``declared`` is the primary subtag of the root element's language.
    """
    declared = F.regexp_extract("html", r"(?i)<html[^>]{0,1000}?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return pages.select(
        "page_id", F.try_to_number(F.regexp_extract("url", r"^[^?#]*/(\d{1,18})(?![^/?#.])", 1), F.lit("9" * 18)).cast("long").alias("doc_id"),
        F.nullif(host, F.lit("")).alias("host"), F.nullif(F.lower(declared), F.lit("")).alias("declared"))


def _domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _suffix(host: Column) -> Column:
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))


def _level(counts: DataFrame, keys: Sequence[str], above: DataFrame | None, top: Column, size: int) -> DataFrame:
    """Shares per language of each group, drawn towards the group above."""
    sums = [F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(size)]
    groups = counts.groupBy(*keys).agg(*sums).withColumn("n", F.array(*[f"n{i}" for i in range(size)]))
    groups = groups.select(*keys, "n") if above is None else groups.select(*keys, "n").join(above, [k for k in keys if k in above.columns])
    base = top if above is None else F.col("share")
    total = F.aggregate("n", F.lit(0.0), lambda a, x: a + x) + PRIOR_WEIGHT
    share = F.zip_with("n", base, lambda n, b: (n + PRIOR_WEIGHT * b) / total)
    return groups.select(*keys, "n", share.alias("share")).drop("n")


def _log(array: Column) -> Column:
    return F.transform(array, lambda x: F.log(x))


def _add(*parts: Column) -> Column:
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)


def identify(docs: DataFrame, evidence: DataFrame, model: TextModel, least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, k1, k2, text_lang, declared, host, lang, probability, accepted.

    ``evidence`` is what ``page_evidence`` gives; a document takes its page
    with the smallest id.  Without a page, its ``source`` stands for the host.
    The posterior is the product of the text's likelihood (tempered), the
    likelihood of the declared language and of the address suffix, and the
    prior of the host.  Those are counted over all documents by grouped
    aggregates of the language that the text alone suggests; hosts are drawn
    towards their domain and domains towards all documents, by
    ``PRIOR_WEIGHT`` observations each.

    A document is rejected (language ``und``) if its text has no letters, or
    no language reaches ``least``; none does where an unlisted language is
    likelier than the known ones by the text (``TextModel.evidence``), as in
    foreign texts or noise of letters.  A few words are too little for that.  Defined cases: null and empty texts are
    rejected; missing evidence says nothing; equal probabilities go to the
    language first by code point; null ids have no page; repeated rows are
    judged alike; an empty table gives an empty table; without any known
    language all are rejected; other columns are not read.

    Texts are read in place here and in ``train``, and not shuffled.  A host with a third of all
    rows is summed inside tasks first, and the joins on hosts, suffixes and
    ids have one row per key on a stored side, so a hot key can be split.
    """
    languages, size = list(model.languages), len(model.languages)
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    keyed = docs.select("doc_id", "source", "text", k1.alias("k1"), k2.alias("k2"))
    read = map_texts(keyed, "text", ["doc_id", "source", "k1", "k2"],
                     T.StructType([T.StructField("text_log", T.ArrayType(T.DoubleType())), T.StructField("none_log", T.DoubleType())]),
                     lambda: lambda text: model.evidence(text) if languages else (None, None))
    likeliest = F.array_position("text_log", F.array_max("text_log")).cast("int")
    best = F.when(F.col("none_log") <= 0, likeliest)  # texts in none of the languages are not counted
    read = stored(read.withColumn("best", best), "text-evidence")
    one = evidence.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min_by(F.struct("host", "declared"), F.struct("page_id", "host", "declared")).alias("page"))
    one = stored(one.select("doc_id", F.col("page.host").alias("page_host"), "page.declared"), "page-evidence")
    known = F.when(F.col("declared").isin(languages), F.col("declared")).when(F.col("declared").isNotNull(), F.lit("other"))
    host = F.coalesce("page_host", F.concat(F.lit("source:"), "source"), F.lit(""))
    read = read.join(one, "doc_id", "left").withColumns({"host": host, "known": known})
    read = stored(read.withColumns({"domain": _domain(F.col("host")), "suffix": _suffix(F.col("page_host"))}), "evidence")
    if not size:
        return read.select("doc_id", "k1", "k2", F.lit(None).cast("string").alias("text_lang"), "declared", "host",
                           F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("probability"), F.lit(False).alias("accepted"))
    one_hot = F.array(*[F.count_if(F.col("best") == i + 1).cast("double") for i in range(size)]).alias("n")
    counts = stored(read.where(F.col("best").isNotNull()).groupBy("host", "domain", "suffix", "known").agg(one_hot), "language-counts")
    totals = counts.agg(*[F.coalesce(F.sum(F.get("n", F.lit(i))), F.lit(0.0)) for i in range(size)]).first()
    everyone = np.array(totals, float) + 1.0
    shares = F.array(*[F.lit(float(s)) for s in everyone / everyone.sum()])
    domains = _level(counts, ["domain"], None, shares, size)
    hosts = stored(_level(counts, ["domain", "host"], domains, shares, size).select("host", _log(F.col("share")).alias("host_log")), "hosts")
    suffixes = counts.where(F.col("suffix").isNotNull()).groupBy("suffix").agg(
        *[F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(size)])
    likely = [(F.col(f"n{i}") + 1.0) / F.lit(float(everyone[i]) + PRIOR_WEIGHT) for i in range(size)]
    suffixes = stored(suffixes.select("suffix", _log(F.array(*likely)).alias("suffix_log")), "suffixes")
    told = {r["known"]: r for r in counts.where(F.col("known").isNotNull()).groupBy("known").agg(
        *[F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(size)]).collect()}
    of = [sum(r[f"n{i}"] for r in told.values()) for i in range(size)]
    zero = F.array(*[F.lit(0.0)] * size)
    markup = zero
    for name in [*languages, "other"]:
        n = [told[name][f"n{i}"] if name in told else 0.0 for i in range(size)]
        logs = np.log((np.array(n) + 0.5) / (np.array(of) + 0.5 * (size + 1)))
        markup = F.when(F.col("known") == name, F.array(*[F.lit(float(x)) for x in logs])).otherwise(markup)
    joined = read.join(hosts, "host", "left").join(suffixes, "suffix", "left")
    total = _add(F.col("text_log"), F.coalesce("host_log", zero), F.coalesce("suffix_log", zero), markup)
    joined = joined.withColumn("total", total).withColumn("top", F.array_max("total"))
    weight = F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    name = F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position("total", F.col("top")).cast("int"))
    # no other evidence speaks for or against an unlisted language; its odds are the text's
    listed = 1.0 / (1.0 + F.exp(F.least("none_log", F.lit(700.0))))
    judged = joined.withColumn("probability", F.coalesce(listed / weight, F.lit(0.0)))
    accepted = F.col("probability") >= least
    text_lang = F.when(F.col("best").isNotNull(), F.element_at(F.array(*[F.lit(x) for x in languages]), F.col("best")))
    return judged.select(
        "doc_id", "k1", "k2", text_lang.alias("text_lang"), "declared", "host",
        F.when(accepted, name).otherwise(F.lit(UNKNOWN)).alias("lang"), "probability", accepted.alias("accepted"))


def drop_unidentified(docs: DataFrame, evidence: DataFrame, model: TextModel, least: float = 0.5) -> DataFrame:
    """``docs`` without the documents that are rejected; same columns."""
    k1, k2 = fresh(docs, "k1", "k2")
    with tidy(docs.sparkSession) as keep:
        gone = identify(docs, evidence, model, least).where("NOT accepted")
        gone = keep(gone.select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct(), "rejected")
    first, second = row_key(F.col("doc_id"), F.col("text"))
    return docs.withColumns({k1: first, k2: second}).join(gone, [k1, k2], "left_anti").select(*docs.columns)
