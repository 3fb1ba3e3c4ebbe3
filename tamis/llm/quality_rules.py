"""Quality rules, line first: judge every line, drop the failing ones, then reject documents that lose too much.

A line fails for the first of these reasons that holds:

* ``boilerplate``: it holds one of the phrases of ``Rules.phrases`` (ASCII letters in either case);
* ``navigation``: at least ``min_separators`` separators, and one for every ``words_per_separator`` words;
* ``punctuation``: symbols beyond ``symbols_per_word``, exclamation runs on half of its words, capitals
  only over ``min_prose_words`` words or more, or that many words without a closing mark at its end.

Lines without a word count for nothing. A document is rejected when its failing lines hold more than
``max_lost`` of the bytes of all its lines (ends stripped), or when the word rules below reject it.

Per document: words, their characters, symbols, repeated lines and words in repeated windows. The work
is row-local, so there is no shuffle, and a lost task repeats its own input split.

Defined cases: a null text is an empty one; an empty text has zero counts and is rejected by the
minimum of words; repeated rows and equal ids are judged each on its own; an empty table gives an empty
result; only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
NOISE = "#*$%&<>"
SEPARATORS = ("|", "·", "•", "»", "›")
CLOSING = (".", "!", "?", ":", ";", ",", "…", '"', "'", "”", "’", "»", ")", "]")
PHRASES = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here", "read more",
    "sign in", "subscribe to", "newsletter", "enable javascript", "share this", "skip to content", "powered by", "back to top",
    "licensed under", "released under the",
)


@dataclass(frozen=True)
class Rules:
    phrases: tuple[str, ...] = PHRASES
    min_separators: int = 2
    words_per_separator: int = 4
    symbols_per_word: float = 0.25
    min_prose_words: int = 5
    max_lost: float = 0.6
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5


OUTPUT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_boilerplate long,"
    " n_navigation long, n_punctuation long, line_bytes long, lost_bytes long, base_failed boolean, kept boolean"
)


def line_fault(line: bytes, rules: Rules, phrases: list[bytes]) -> str | None:
    """Why a line (ends stripped, not empty) fails, or None. ``phrases``: those the text may hold."""
    if phrases:
        low = line.lower()
        if any(p in low for p in phrases):
            return "boilerplate"
    words = line.count(b" ") + 1
    separators = sum(line.count(s) for s in _SEPARATORS)
    if separators >= rules.min_separators and separators * rules.words_per_separator >= words:
        return "navigation"
    if b"!!" in line and 2 * line.count(b"!!") >= words:
        return "punctuation"
    noise = sum(line.count(s) for s in _NOISE)
    if noise >= 2 and noise >= rules.symbols_per_word * words:
        return "punctuation"
    if words >= rules.min_prose_words and (line.isupper() or not line.endswith(_CLOSING)):
        return "punctuation"
    return None


_SEPARATORS = [s.encode() for s in SEPARATORS]
_NOISE = [s.encode() for s in NOISE]
_SYMBOLS = [s.encode() for s in SYMBOLS]
_CLOSING = tuple(s.encode() for s in CLOSING)
_SPACES = [bytes([b]) for b in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)]


def repeated_words(words: list[bytes], size: int) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, upto = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + size - max(at, upto)
            upto = at + size
    return covered


def judge(text: bytes, chars: int, rules: Rules) -> tuple[tuple, list[bytes]]:
    """The figures of one UTF-8 text in the order of ``OUTPUT``, and the lines it keeps."""
    words = text.split()  # bytes split at the six ASCII white-space characters
    lines = text.split(b"\n")
    stripped = [s for s in (line.strip() for line in lines) if s]
    low = text.lower()
    phrases = [p for p in (x.encode() for x in rules.phrases) if p in low]
    with_word = [line for line in lines if line.strip()]
    repeats = repeated_words(words, rules.window)
    kept, faults, lost = [], Counter(), 0
    for line in stripped:
        fault = line_fault(line, rules, phrases)
        if fault is None:
            kept.append(line)
        else:
            faults[fault] += 1
            lost += len(line)
    total = sum(map(len, stripped))
    failed = len(words) < rules.min_words or 100 * repeats > rules.max_repeat_percent * len(words)
    figures = (
        len(words),
        chars - sum(text.count(s) for s in _SPACES),
        sum(text.count(s) for s in _SYMBOLS),
        len(with_word) - len(set(with_word)),
        repeats,
        len(stripped),
        faults["boilerplate"],
        faults["navigation"],
        faults["punctuation"],
        total,
        lost,
        failed,
        not failed and lost <= rules.max_lost * total,
    )
    return figures, kept


def judge_documents(df: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules = Rules(), cleaned: bool = False) -> DataFrame:
    """One row per row of ``df``: key, the figures of ``OUTPUT`` and, if wanted, ``clean_text`` of the kept lines."""
    names = [part.split()[0] for part in OUTPUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, chars = batch.column(1).cast(pa.binary()).to_pylist(), pc.utf8_length(batch.column(1)).to_pylist()
            rows = [judge(t, n, rules) for t, n in zip(texts, chars)]
            columns = [pa.array(c) for c in zip(*(r[0] for r in rows))] if rows else [pa.array([])] * len(names)
            types = [pa.bool_() if n in ("base_failed", "kept") else pa.int64() for n in names]
            out = [batch.column(0), *[c.cast(t) for c, t in zip(columns, types)]]
            if cleaned:
                out.append(pa.array([b"\n".join(r[1]).decode() for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=[key, *names, *["clean_text"] * cleaned])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, {OUTPUT}" + ", clean_text string" * cleaned)
