"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has a zstandard raw-content dictionary of labelled texts.  A text is cut into blocks; each is
compressed with every dictionary, so that what a text has already said does not stand in for the dictionary.  The
sums of sizes over the whole text are compared; a narrow margin between the best two is a rejection.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewarden.llm.common import column, held_out, nonempty

#: Bounds of the training sample: texts for each language, and characters of each that go into its dictionary.
TEXTS, TEXT_CHARS = 64, 2048
#: Characters compressed together.
BLOCK_CHARS = 1024
#: Least lead of the best language over the next, as a share of the smallest size and in bytes; below, a text is rejected.
MARGIN, LEAST_BYTES = 0.08, 3
#: Texts shorter than this are compressed behind as many bytes of the dictionary.
LEAD = 256
UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")


def train(docs: DataFrame, texts: int = TEXTS, text_chars: int = TEXT_CHARS) -> dict[str, bytes]:
    """A dictionary for each non-null ``lang`` of ``docs``, from rows that are not held out.

    The sample takes, for each language and each of ``texts`` slots, the row with the smallest hash: an aggregate of
    whole numbers with partial sums, whatever share of rows a language has.  A longer text gives ``text_chars``
    characters from a place chosen by hash, not its start, where many share a heading.  What comes to the driver is
    bounded by ``texts * text_chars`` characters for each language.
    """
    rows = (docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
            .select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), F.xxhash64("text")).alias("mark")))
    chosen = rows.groupBy("lang", F.pmod(F.col("mark"), F.lit(texts)).alias("slot")).agg(F.min("mark").alias("mark"))
    few = F.broadcast(chosen.select("lang", "mark"))
    places = F.greatest(F.length("text") - text_chars, F.lit(0)) + 1
    start = (1 + F.pmod(F.xxhash64("mark"), places)).cast("int")
    got = rows.join(few, ["lang", "mark"]).select("lang", "mark", F.col("text").substr(start, F.lit(text_chars)).alias("text")).distinct()
    parts: dict[str, list[str]] = {}
    for row in got.orderBy("lang", "mark").collect():
        parts.setdefault(row["lang"], []).append(row["text"])
    return {lang: letters(" ".join(p)).encode() for lang, p in sorted(parts.items())}


@lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> list:
    """For each language the compressor, the end of its dictionary, and what that takes."""
    made = []
    for _, content in dictionaries:
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(
            3, dict_size=len(content), source_size=BLOCK_CHARS, min_match=3, strategy=zstandard.STRATEGY_BTOPT,
            write_content_size=False, write_checksum=False, write_dict_id=False)
        words.precompute_compress(compression_params=how)
        compressor, lead = zstandard.ZstdCompressor(compression_params=how, dict_data=words), content[-LEAD:]
        made.append((compressor, lead, len(compressor.compress(lead))))
    return made


def letters(text: str) -> str:
    """Words in small letters; all else becomes one space."""
    return _OTHER.sub(" ", text).lower()


def sizes(text: str, compressors: list) -> list[int]:
    """Bytes of the whole text by each dictionary.

    Zstandard stores very short input as it is.  A short text therefore follows the end of the dictionary, and what
    that takes alone is not counted.
    """
    blocks = [text[i:i + BLOCK_CHARS].encode() for i in range(0, len(text), BLOCK_CHARS)]
    if len(text) < LEAD:
        return [max(1, len(c.compress(lead + text.encode())) - alone) for c, lead, alone in compressors]
    return [sum(len(c.compress(b)) for b in blocks) for c, _, _ in compressors]


def decide(text: str | None, langs: list[str], compressors: list) -> tuple[str, float, float, int]:
    """Language, score, margin and the margin in bytes.  Score is a share of 1 by how much smaller each language makes a block."""
    if text is None or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, 0.0, 0
    if not langs:
        return UNDETERMINED, 0.0, 0.0, 0
    total = sizes(letters(text), compressors)
    order = sorted(range(len(langs)), key=lambda i: (total[i], langs[i]))
    best = total[order[0]]
    lead = total[order[1]] - best if len(order) > 1 else max(best, LEAST_BYTES)
    margin = lead / best if len(order) > 1 else 1.0
    share = 1 / sum(math.exp(-min(60.0, 100 * (t - best) / best)) for t in total)
    return langs[order[0]], share, margin, lead


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), margin and accepted.

    ``lang_pred`` is a learned language, or ``und`` for a null text, one without a letter, or where no language was
    learned; these score 0.  ``accepted`` is false for ``und`` and where the margin is below ``margin`` or fewer than
    ``least_bytes`` (one byte of a short text is a wide margin and says nothing).  Columns of ``docs`` with one
    of these names are replaced.  Rows are scored one by one: repeated rows score alike.
    """
    fixed = tuple(sorted(dictionaries.items()))
    langs = [lang for lang, _ in fixed]
    docs = docs.drop("lang_pred", "score", "margin", "accepted")
    made = StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double").add("margin", "double").add("accepted", "boolean")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(fixed)
        for batch in nonempty(batches):
            texts = column(batch, "text")
            found = [decide(texts[i].as_py(), langs, compressors) for i in range(len(texts))]
            out = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                   pa.array([f[2] for f in found], pa.float64()),
                   pa.array([f[0] != UNDETERMINED and f[2] >= margin and f[3] >= least_bytes for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "lang_pred", "score", "margin", "accepted"])

    return docs.mapInArrow(score, made)
