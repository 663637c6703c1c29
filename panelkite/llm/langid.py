"""Language identification by compression.

For each language a raw-content dictionary is cut from sample texts. A text is encoded piece by piece
with every dictionary; the language whose dictionary makes it smallest is chosen.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

SAMPLE_DOCS = 400  # texts of each language that its dictionary is cut from
SAMPLE_CHARS = 400  # of each
DICTIONARY_BYTES = 131072
LEVEL = 6
PIECE_BYTES = 1000
MIN_MARGIN = 0.001  # where too little was learned to derive one
CALIBRATION_DOCS = 200  # texts of each language that the margin is derived from
CALIBRATION_CHARS = 2000  # of each, none of them in a dictionary
LOST = 0.02  # share of the right predictions among those that the margin may reject
PASSED = 0.05  # share of texts in languages not learned that it may let pass
UNDECIDED = "und"

LETTERS = re.compile(r"[^\W\d_]+")


def plain(text: str | None) -> bytes:
    """The lower-cased runs of letters, parted by single spaces."""
    return " ".join(LETTERS.findall((text or "").lower())).encode("utf-8")


class Dictionaries(dict):
    """Language to dictionary, and the least margin derived from the rows that were learned."""

    min_margin = MIN_MARGIN


def learn(labelled: DataFrame, docs: int = SAMPLE_DOCS) -> Dictionaries:
    """A dictionary for each language of `labelled` (doc_id, text, lang), the most frequent first.

    Fitted on a bounded sample: of each language, the `docs` texts least in a hash of doc_id, and of
    each the first SAMPLE_CHARS characters. Rows are thinned to a few times that number before the
    driver sees them. Rows without a text, language or doc_id do not count. The least margin comes with
    the dictionaries (``derived_margin``).
    """
    rows = labelled.select("doc_id", "text", "lang").dropna()
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Dictionaries()
    shares = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4.0 * docs / n))))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    share = (order / F.lit(2.0**63) + 1) / 2
    sample = (
        rows.where(share <= shares[F.col("lang")])
        .select(
            "lang", order.alias("at"), F.substring("text", 1, SAMPLE_CHARS).alias("text"),
            F.substring("text", SAMPLE_CHARS + 1, CALIBRATION_CHARS).alias("rest"),
        )
        .collect()
    )
    found: dict[str, list[bytes]] = {}
    apart: dict[str, list[bytes]] = {}  # text that is in no dictionary: further rows, and what follows a sample
    for r in sorted(sample, key=lambda r: (r["lang"], r["at"], r["text"])):
        texts = found.setdefault(r["lang"], [])
        texts.append(plain(r["text"]))
        apart.setdefault(r["lang"], []).append(plain(r["rest"] if len(texts) <= docs else r["text"] + r["rest"]))
    often = sorted(found, key=lambda lang: (-counts[lang], lang))
    learned = Dictionaries((lang, b" ".join(found[lang][:docs])[:DICTIONARY_BYTES]) for lang in often)
    usable = {lang: [t for t in reversed(texts) if t][:CALIBRATION_DOCS] for lang, texts in apart.items()}
    learned.min_margin = derived_margin(learned, usable)
    return learned


def derived_margin(dictionaries: dict[str, bytes], texts: dict[str, list[bytes]]) -> float:
    """The least margin, from `texts` of each language.

    The margins of right predictions are set against those of wrong ones and of each text when its own
    dictionary is left out, as if its language had not been learned. The margin lets PASSED of the
    latter pass, but does not reject more than LOST of the former.
    """
    encoders, right, wrong = _encoders(dictionaries), [], []
    for lang, some in texts.items():
        for text in some:
            sizes = _sizes(encoders, text)
            best, margin = _ranked(sizes)
            (right if best == lang else wrong).append(margin)
            others = {k: n for k, n in sizes.items() if k != lang}
            if len(others) > 1:
                wrong.append(_ranked(others)[1])
    if not right or not wrong or len(dictionaries) < 2:
        return MIN_MARGIN
    low, high = sorted(right)[int(LOST * len(right))], sorted(wrong)[int((1 - PASSED) * len(wrong))]
    return max(MIN_MARGIN, min(low, high))


def _encoders(dictionaries: dict[str, bytes]) -> dict:
    import zstandard as zstd

    encoders = {}
    for lang, content in dictionaries.items():
        content = content if len(content) >= 8 else content.ljust(8)
        known = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        how = zstd.ZstdCompressionParameters.from_level(
            LEVEL, source_size=PIECE_BYTES, dict_size=len(content), min_match=4,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        known.precompute_compress(compression_params=how)
        encoders[lang] = zstd.ZstdCompressor(dict_data=known, compression_params=how)
    return encoders


def _sizes(encoders: dict, letters: bytes) -> dict[str, int]:
    sizes = dict.fromkeys(encoders, 0)
    for a in range(0, len(letters), PIECE_BYTES):
        piece = letters[a : a + PIECE_BYTES]
        for lang, encoder in encoders.items():
            sizes[lang] += len(encoder.compress(piece))
    return sizes


def _ranked(sizes: dict[str, int]) -> tuple[str, float]:
    """The smallest and its margin; of equal ones, the more frequent first."""
    ranked = sorted(sizes, key=sizes.__getitem__)
    if len(ranked) == 1:
        return ranked[0], 1.0
    return ranked[0], (sizes[ranked[1]] - sizes[ranked[0]]) / sizes[ranked[1]]


def _identify(dictionaries: dict[str, bytes], min_margin: float, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoders(dictionaries)
        for batch in slices(batches):
            texts = batch.column("text")
            rows = [_choose(encoders, text.as_py(), min_margin) for text in texts]
            lang, score, margin, rejected = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kept),
                    pa.array(lang, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(margin, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                names=[*kept, "lang_pred", "score", "margin", "rejected"],
            )

    return run


def _choose(encoders: dict, text: str | None, min_margin: float) -> tuple[str, float, float, bool]:
    letters = plain(text)
    if not letters or not encoders:
        return UNDECIDED, 0.0, 0.0, True
    sizes = _sizes(encoders, letters)
    lang, margin = _ranked(sizes)
    best = sizes[lang]
    scale = 1 + best / 100
    score = 1 / sum(math.exp((best - size) / scale) for size in sizes.values())
    return lang, score, margin, margin < min_margin


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float | None = None, keep_text: bool = True
) -> DataFrame:
    """`docs` with lang_pred, score, margin and rejected; without its text if `keep_text` is false.

    `score` compares the encoded sizes of all languages (0 to 1); `margin` is how much smaller the best
    is than the second, as a share of that. A document is rejected if the margin is below
    `min_margin`, or the one learned with the dictionaries. Whole texts are encoded, in pieces of PIECE_BYTES bytes.

    A text without a letter, a null one, and any text when nothing was learned is ``und``, with score
    0, and rejected. With one language only, every text with letters is of that language. Ties go to
    the language learned from more rows. Rows stay as they are, repeated or not; other columns pass
    through, those with the names of the results are replaced; an empty table gives an empty one.
    """
    if min_margin is None:
        min_margin = getattr(dictionaries, "min_margin", MIN_MARGIN)
    made = ("lang_pred", "score", "margin", "rejected")
    rows = docs.drop(*made)
    fields = [f for f in rows.schema.fields if keep_text or f.name != "text"]
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    schema = ", ".join([*types, "lang_pred string", "score double", "margin double", "rejected boolean"])
    return rows.mapInArrow(_identify(dict(dictionaries), min_margin, [f.name for f in fields]), schema)
