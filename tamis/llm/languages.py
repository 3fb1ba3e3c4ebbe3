"""Language identification by compression: the language whose sample compresses a text best.

Every language gets a zstandard dictionary of raw content: pieces of its own training texts. A text is compressed
once per language with that language's dictionary and the smallest size wins. Long texts are compressed in chunks,
each of which starts from the dictionary again, so that all of a text counts and its own beginning does not stand
in for the language. Narrow margins are rejected.

Before both steps ASCII letters alone are kept of ASCII (runs of others are one space) and texts are lower-cased.

Defined results: a null text, a text without a letter, and any text where nothing was learned are ``und`` with
score 0 and are not accepted. Equal sizes go to the language with more training texts, then to the smaller name;
they score 0. With a single language learned, the rival is compression without a dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NONE = "und"
ROWS = 256
LETTER = regex.compile(r"\p{L}")
_BLANK = bytes(c for c in range(128) if not chr(c).isalpha())
_SPACED = bytes.maketrans(_BLANK, b" " * len(_BLANK))


@dataclass(frozen=True)
class Settings:
    """``pieces`` pieces of ``piece`` bytes are the sample of a language, so a dictionary has 64 KiB at most;
    more than ``languages`` languages are refused, so the model is bounded by 64 MiB. ``margin``: the share of the
    second size by which the first must be smaller to be accepted."""

    pieces: int = 256
    piece: int = 256
    chunk: int = 2_048
    level: int = 9
    margin: float = 0.01
    languages: int = 1_000


@dataclass(frozen=True)
class Model:
    """Languages, those with more training texts first, and their dictionaries."""

    names: list[str]
    samples: list[bytes]
    settings: Settings = Settings()


def normalised(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split())


def _draw(settings: Settings):
    """Per task and language the pieces with the smallest hashes; equal pieces have equal hashes."""
    step, wanted = settings.piece, settings.pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, bytes]] = {}
        limit: dict[str, int] = {}

        def shrink(lang: str) -> None:
            least = sorted(held[lang])[:wanted]
            if len(least) == wanted:
                limit[lang] = least[-1]
            held[lang] = {h: held[lang][h] for h in least}

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                whole = normalised(text.decode("utf-8", "replace"))
                mine, bound = held.setdefault(lang, {}), limit.get(lang, 1 << 64)
                for at in range(0, len(whole), step):
                    piece = whole[at : at + step]
                    h = xxhash.xxh64_intdigest(piece)
                    if h <= bound:
                        mine[h] = piece
                if len(mine) > 4 * wanted:
                    shrink(lang)
        for lang in held:
            shrink(lang)
            if held[lang]:
                # hexadecimal digits keep the order of unsigned numbers
                hashes = [f"{h:016x}" for h in held[lang]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(hashes)), pa.array(hashes), pa.array(list(held[lang].values()), pa.binary())],
                    names=["lang", "h", "piece"],
                )

    return run


def learn(df: DataFrame, lang: str = "lang", text: str = "text", settings: Settings = Settings()) -> Model:
    """Fit on the rows of ``df`` with a language and a text.

    All pieces of all texts compete; those with the smallest hashes win, wherever they stand. Tasks keep no more
    than the winners among their own, so what is shuffled does not grow with copies or long texts.
    """
    known = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = known.groupBy("lang").count().limit(settings.languages + 1).collect()
    if len(counts) > settings.languages:
        raise ValueError(f"more than {settings.languages} languages to learn")
    drawn = known.mapInArrow(_draw(settings), "lang string, h string, piece binary").dropDuplicates(["lang", "h"])
    first = drawn.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= settings.pieces)
    pieces: dict[str, list[tuple[str, bytes]]] = {}
    for r in first.select("lang", "h", "piece").collect():
        pieces.setdefault(r["lang"], []).append((r["h"], bytes(r["piece"])))
    names = [r["lang"] for r in sorted(counts, key=lambda r: (-r["count"], r["lang"])) if r["lang"] in pieces]
    return Model(names, [b" ".join(p for _, p in sorted(pieces[n])) for n in names], settings)


def _compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    level = model.settings.level
    out = []
    for sample in model.samples:
        words = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False))
    if len(out) == 1:
        out.append(zstandard.ZstdCompressor(level=level, write_content_size=False))
    return out


class Judge:
    """Sizes and verdicts of texts under a model."""

    def __init__(self, model: Model):
        self.model, self.compressors = model, _compressors(model)

    def sizes(self, whole: bytes) -> np.ndarray:
        step = self.model.settings.chunk
        parts = [whole[at : at + step] for at in range(0, len(whole), step)]
        return np.array([sum(len(c.compress(p)) for p in parts) for c in self.compressors], np.int64)

    def verdict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted). The score is 0 for a tie, 0.5 at the margin, and goes to 1."""
        if not self.model.names or text is None or not LETTER.search(text):
            return NONE, 0.0, False
        sizes = self.sizes(normalised(text))
        order = np.argsort(sizes, kind="stable")
        first = int(order[0])
        if first >= len(self.model.names):  # one language, and no dictionary does better than its own
            return self.model.names[0], 0.0, False
        lead = float(sizes[order[1]] - sizes[first]) / float(sizes[order[1]])
        score = lead / (lead + self.model.settings.margin) if lead else 0.0
        return self.model.names[first], score, lead >= self.model.settings.margin


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept columns, best, lang_found, score, accepted) of every row; ``lang_found`` is ``und`` where not accepted."""
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["best string, lang_found string, score double, accepted boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
                found = [judge.verdict(None if t is None else t.decode("utf-8", "replace")) for t in texts]
                best, scores, accepted = (list(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:-1],
                        pa.array(best, pa.string()),
                        pa.array([b if a else NONE for b, a in zip(best, accepted)], pa.string()),
                        pa.array(scores, pa.float64()),
                        pa.array(accepted, pa.bool_()),
                    ],
                    names=[*keep, "best", "lang_found", "score", "accepted"],
                )

    return df.select(*keep, F.col(text).alias("_whole")).mapInArrow(run, schema)
