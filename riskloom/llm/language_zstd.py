"""Language identification by compression.

Every language gets a raw-content dictionary: letters of a bounded hash sample of its training documents.  A
text is compressed block by block with each dictionary (zstandard); the language whose dictionary gives the
fewest bytes wins.  A narrow margin between the two smallest sums marks the decision as rejected.

The sample is about ``MAX_DOCS`` documents of a language with at most ``SNIPPET`` letters of each (the
middle), in the order of a hash of doc_id and cut to ``DICTIONARY`` bytes, so that a dictionary holds documents
from all over the ids; texts to be classified are read whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any training
language every text is ``und``; ties go to the first language in code-point order; repeated rows are
classified alike; null or empty languages teach nothing; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_remainder, draw_limit, drawn

#: Training documents per language, in expectation, letters of each, and bytes of a dictionary.
MAX_DOCS, SNIPPET, DICTIONARY = 400, 2_000, 112_640
#: Bytes of text compressed at a time, and the compression level; texts of up to SHORT bytes are worth a slower one.
BLOCK, LEVEL = 8_192, 9
SHORT, SHORT_LEVEL = 600, 12
#: Languages beyond this number are an error: each is one more pass over every text.
MAX_LANGUAGES = 1_000
#: A decision is rejected when the best total is not smaller than the second by this share.
MIN_MARGIN = 0.01
UNKNOWN = "und"

_SENTENCE = re.compile(r"[.!?\n]+")
_GAP = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-cased letters with single spaces between words."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def dictionaries(docs: DataFrame, train: Column, max_docs: int = MAX_DOCS) -> dict[str, bytes]:
    known = docs.filter(train & (F.coalesce(F.col("lang"), F.lit("")) != "") & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return {}
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], draw_limit(min(1.0, max_docs / r["count"])))))
    picked = known.filter(drawn(share[F.col("lang")], "dictionary"))
    middle = F.greatest(F.lit(1), ((F.length("text") - SNIPPET) / 2).cast("int") + 1)
    rows = picked.select("lang", "doc_id", F.substring(F.col("text"), middle, F.lit(SNIPPET)).alias("t")).collect()   # bounded
    order = lambda i: blake2b(str(i).encode(), digest_size=8).digest()
    return contents_of(sorted(((r["lang"], order(r["doc_id"]), r["t"]) for r in rows)))     # a dictionary may hold a part only


def contents_of(rows: list[tuple]) -> dict[str, bytes]:
    """Dictionary of each language from (lang, .., text) rows.  A sentence that several languages share, such as a
    licence line or a passage that is copied everywhere, tells nothing and is left out; of repeats one stays."""
    seen: dict[str, set[str]] = {}
    cut = [(r[0], [letters(x) for x in _SENTENCE.split(r[-1])]) for r in rows]
    for lang, sentences in cut:
        for x in sentences:
            seen.setdefault(x, set()).add(lang)
    out: dict[str, list[bytes]] = {}
    for lang, sentences in cut:
        for x in sentences:
            if x and len(seen[x]) == 1:
                seen[x] = {lang, UNKNOWN}              # taken
                out.setdefault(lang, []).append(x.encode("utf-8", "replace"))
    return {k: b" ".join(v)[:DICTIONARY] for k, v in out.items()}


_COMPRESSORS: dict[tuple, list] = {}


def compressors(contents: dict[str, bytes]) -> list:
    """(language, compressor, compressor of short texts) in code-point order, made once in each worker process."""
    key = tuple(sorted((k, hash(v), len(v)) for k, v in contents.items()))
    if key not in _COMPRESSORS:
        _COMPRESSORS.clear()
        _COMPRESSORS[key] = [(lang, *(_coder(contents[lang], level) for level in (LEVEL, SHORT_LEVEL)))
                             for lang in sorted(contents)]
    return _COMPRESSORS[key]


def _coder(content: bytes, level: int):
    import zstandard

    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=False, write_content_size=False,
                                    write_dict_id=False)


def classify(text: str | None, coders: list) -> tuple[str, float, bool]:
    """Language, score and whether the margin is too narrow."""
    raw = letters(text).encode("utf-8", "replace")
    if not raw or not coders:
        return UNKNOWN, 0.0, True
    blocks = [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]
    sizes = [sum(len((short if len(raw) <= SHORT else long).compress(b)) for b in blocks) for _, long, short in coders]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    rest = [s for i, s in enumerate(sizes) if i != best]
    if not rest:
        return coders[best][0], 1.0, False
    spread = sum(math.exp(-min(60.0, 0.5 * (s - sizes[best]))) for s in rest)
    return coders[best][0], 1.0 / (1.0 + spread), min(rest) - sizes[best] < MIN_MARGIN * min(rest)


def identify(docs: DataFrame, contents: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row."""
    def run(batches):
        coders = compressors(contents)
        for batch in batches:
            out = [classify(t, coders) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()),
                 pa.array([o[2] for o in out], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op9_language_zstd(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    contents = dictionaries(docs, doc_remainder(F.col("doc_id"), 5) != 0)
    held = doc_remainder(F.col("doc_id"), 5) == 0
    return identify(docs, contents).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
