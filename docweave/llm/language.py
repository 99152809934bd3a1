"""Language identification by compression: the language whose zstandard raw-content dictionary encodes a text in the
fewest bytes is its language.

Learning takes whole labelled texts: of each language those of least crc32 of the id, until SAMPLE_ROWS texts or
SAMPLE_BYTES bytes are reached. All languages together get SAMPLE_TOTAL bytes and share them evenly, so the driver's
part is bounded and no language is left out (each gets one text at least). Prediction reads whole texts, lower-cased and
without marks and digits, in blocks of BLOCK characters, so that a long text can't teach itself.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget

SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_TOTAL, BLOCK, LEVEL = 256, 192 << 10, 64 << 20, 2048, 3
_OTHER = re.compile(r"[\W\d_]+")
#: A text is rejected when the two best languages differ by less than this share of the best one's bytes.
MARGIN = 0.002


def folded(text: str) -> str:
    """Lower-case words, one space around each."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def learn(docs: DataFrame, usable: Column, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, total: int = SAMPLE_TOTAL) -> dict[str, bytes]:
    """A dictionary for each language from a bounded sample of whole texts of docs (doc_id, text, lang).

    The first pass picks rows by id and hash alone, the second reads the picked ones' texts. Null and blank texts and
    null languages teach nothing, repeated rows once; no labelled rows give no dictionary.
    """
    labelled = docs.where(usable & F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0))
    languages = max(1, labelled.select("lang").distinct().count())
    rows, size = max(1, min(rows, total // size * rows // languages)), max(1, min(size, total // languages))
    keyed = labelled.select("lang", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("c"), "doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"), "text")
    order = Window.partitionBy("lang").orderBy("c", "doc_id", "h")
    first = keyed.drop("text").withColumn("i", F.row_number().over(order)).where(F.col("i") <= rows)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = first.withColumn("before", before).where(F.col("before") < size).select("lang", "c", "doc_id", "h").distinct()  # rows texts a language
    chosen = keyed.join(F.broadcast(picked), ["lang", "c", "doc_id", "h"], "left_semi").dropDuplicates(["lang", "doc_id", "h"])
    texts: dict[str, list[str]] = defaultdict(list)
    for r in sorted(chosen.select("lang", "c", "doc_id", "h", "text").collect()):
        texts[r["lang"]].append(r["text"])
    return {lang: "".join(map(folded, parts)).encode() for lang, parts in texts.items()}


def scorer(dictionaries: dict[str, bytes]) -> Callable[[str], tuple[str, float, bool]]:
    import zstandard as z

    encoders = []
    for lang in sorted(dictionaries):
        d = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
        how = z.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(dictionaries[lang]), write_checksum=False, write_content_size=False, write_dict_id=False)
        d.precompute_compress(compression_params=how)
        encoders.append((lang, z.ZstdCompressor(compression_params=how, dict_data=d)))

    def score(text: str | None) -> tuple[str, float, bool]:
        if not text or not encoders or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        text = folded(text)
        blocks = [text[i : i + BLOCK].encode() for i in range(0, len(text), BLOCK)]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in encoders)
        best = sizes[0][0]
        margin = 1.0 if len(sizes) == 1 else (sizes[1][0] - best) / best
        return sizes[0][1], min(1.0, margin), margin < MARGIN

    return score


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """docs with lang_pred, score (how much longer the second-best code is, as a share, at most 1) and rejected.

    Null texts and texts without a letter are `und` with score 0, and so is all if nothing was learned; of
    languages that tie the first in order is given, and the text rejected. Other columns stay, but for those three.
    """
    given = docs.drop("lang_pred", "score", "rejected")
    columns = given.columns
    at = columns.index("text")
    schema = T.StructType([*given.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        score = scorer(dictionaries)
        for batch in batches:
            found = [score(t.as_py()) for t in batch.column(at)]
            langs, scores, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*columns, "lang_pred", "score", "rejected"])

    return given.mapInArrow(predict, schema)


def held_out() -> Column:
    """Documents whose crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
