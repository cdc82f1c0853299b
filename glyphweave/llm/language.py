"""Language identification by compression.

A language is a zstandard raw-content dictionary of text in it. A text is compressed, block by block,
with the dictionary of every language; the language whose output is smallest wins. A text is rejected
when the margin to the runner-up is narrow.

Dictionaries are fitted on a bounded sample: for each language the SAMPLE_ROWS distinct training texts
that hash lowest, of each a span of up to SPAN characters at a place given by its hash, up to
DICTIONARY bytes. Copies of a text count once. That and the count of each language is all that comes to
the driver, at most SAMPLE_ROWS * SPAN characters of each of at most LANGUAGES languages.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few, table

SAMPLE_ROWS = 600
SPAN = 1000
DICTIONARY = 400_000
LEVEL = 6
BLOCK = 2048
#: Blocks below this many bytes are compressed at SHORT_LEVEL, which finds matches of three bytes, behind
#: a LEAD of the dictionary's own last bytes: alone they'd be stored as they are, the same for every language.
SHORT = 512
SHORT_LEVEL = 19
LEAD = 256
#: Of the held-out texts of check_s with a margin below this, a quarter are told right; from it on, 99 in 100.
MARGIN = 0.005
#: Labels that are learned: those with most distinct texts.
LANGUAGES = 200
UNDETERMINED = "und"

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-cased words without digits, signs and marks between them."""
    return _OTHER.sub(" ", text.lower()).strip()


def held_out(id_col: str) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 1 when divided by 3 (a null id is neither held out nor trained on)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", languages: int = LANGUAGES) -> dict[str, bytes]:
    """Raw dictionary content of the languages of a table of labelled rows, `languages` at most. Null texts and labels are left out."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    # Distinct texts to within a few hundredths; only a bound is made of them, which leaves about four times the sample.
    counts = dict(rows.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect())
    if not counts:
        return {}
    h = F.xxhash64("text")
    place = F.pmod(h, F.greatest(F.length("text") - SPAN, F.lit(0)) + 1).cast("int") + 1
    # The lowest hashes of a language lie below a bound that its count of distinct texts tells, so few rows are dealt out, however common it is.
    level = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 40))
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, 4 * SAMPLE_ROWS / max(n, 1))))])
    spans = rows.select("lang", level.alias("h"), F.substring("text", place, F.lit(SPAN)).alias("span")).filter(F.col("h") < share[F.col("lang")] * (1 << 40)).distinct()
    lowest = Window.partitionBy("lang").orderBy("h", "span")
    picked = spans.withColumn("n", F.row_number().over(lowest)).filter(F.col("n") <= SAMPLE_ROWS)
    parts: dict[str, list[str]] = {}
    for r in sorted(picked.select("lang", "n", "span").collect()):
        parts.setdefault(r["lang"], []).append(letters(r["span"]))
    return {lang: " ".join(dict.fromkeys(x)).encode()[:DICTIONARY] for lang, x in parts.items()}


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        self.langs = sorted(content)
        self.by_level: dict[int, list[zstandard.ZstdCompressor]] = {}
        for level in (LEVEL, SHORT_LEVEL):
            self.by_level[level] = []
            for lang in self.langs:
                d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                self.by_level[level].append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        self.leads = [content[lang][-LEAD:] for lang in self.langs]
        self.lead_sizes = [len(z.compress(lead)) for z, lead in zip(self.by_level[SHORT_LEVEL], self.leads, strict=True)]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, margin from 0 to 1 (the runner-up's bytes that the winner saves), and whether it is accepted."""
        data = letters(text or "").encode()
        if not data or not self.langs:
            return UNDETERMINED, 0.0, False
        sizes = [0] * len(self.langs)
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            if len(block) < SHORT:
                for k, z in enumerate(self.by_level[SHORT_LEVEL]):
                    sizes[k] += len(z.compress(self.leads[k] + block)) - self.lead_sizes[k]
            else:
                for k, z in enumerate(self.by_level[LEVEL]):
                    sizes[k] += len(z.compress(block))
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        margin = 1.0 if len(order) == 1 else min(1.0, max(0.0, (sizes[order[1]] - sizes[order[0]]) / max(sizes[order[1]], 1)))
        return self.langs[order[0]], margin, margin >= MARGIN


def _classify(content: dict[str, bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(content)
        for batch in few(batches):
            found = [judge(t) for t in batch.column(2).to_pylist()]
            lang, score, accepted = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    return run


def identify(docs: DataFrame, content: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (the margin), accepted.

    A text that is null or has no letter is `und` with score 0, and so is any text if nothing was
    learned; both are rejected. Equal outputs go to the language first in order, with margin 0, and
    are rejected. Repeated rows each get a row. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_classify(content), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def _keep_told(content: dict[str, bytes], at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(content)
        for batch in few(batches):
            yield batch.filter(pa.array([judge(t)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

    return run


def keep_told(docs: DataFrame, content: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text the classifier accepts (see identify); nothing is shuffled."""
    return docs.mapInArrow(_keep_told(content, docs.columns.index(text_col)), docs.schema)


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries from the rows of `documents` that aren't held out."""
    return fit(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
