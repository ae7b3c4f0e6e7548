"""Alignment of an annotator's segments with the untouched source: nothing lost, nothing added, in order.

Comparison ignores white space and the shape of quotes. A segment that comes later than expected is
accepted, what was skipped goes to the narrator with a warning; anything else is an error. Emitted
texts are slices of the source. Direct speech is found by quotation marks: speech that a segment mixes
with narration is split off.

One chunk is one row, so this runs per row over Arrow batches; :func:`verbatim` is the same test for
segments that follow the source exactly, inside the JVM.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import scripts
from lectern.operators.registry import Registry, RegistryError

# Directions, marks, and the wording of warnings.
NARRATION, LATER_CHARS = "Neutral narration.", 8
RECOVERED = "Recovered omitted source as narrator."
GLUED = "Split character speech from glued attribution."
QUOTED = "Quoted speech assigned to narrator; review speaker attribution."
UNCERTAIN = "Uncertain speaker; used narrator."
TRIMMED = "Delivery trimmed to vocal performance"
CLOSING = {"“": "”", "‘": "’", '"': '"', "'": "'"}
OPENERS_BEFORE = "([{—–-"
EVENTS = re.compile(r"[\"'“”‘’]|\n[ \t]*\n")
LETTER = re.compile(r"[^\W_]")  # or digit
HEADING = re.compile(T.SCRIPT_HEADING.removeprefix("(?iU)^"), re.IGNORECASE)


class FidelityError(ValueError):
    """Segments that don't follow the source, or aren't segments."""


def quote_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of direct speech. Speech without an end is dropped; it ends a blank line or a new opening mark earlier.

    Only quotation marks and blank lines are looked at; the text between is never walked.
    """
    spans, start, close = [], None, ""
    for m in EVENTS.finditer(text):
        at, mark = m.start(), m[0]
        before, after = text[at - 1] if at else " ", text[at + 1] if at + 1 < len(text) else " "
        straight = mark == '"' and (before.isspace() or before in OPENERS_BEFORE) and not after.isspace()
        opens = straight or mark == "“"
        if start is not None:
            anew = opens and (close == '"' or (close == "”" and mark == "“"))
            if mark[0] == "\n" or anew:
                spans.append((start, at))
                start = None
            elif mark == close:
                if not (close in "'’" and after.isalnum()):  # an apostrophe
                    spans.append((start, at + 1))
                    start = None
                continue
        if start is None and (opens or mark == "‘" or (mark == "'" and not before.isalnum())):
            start, close = at, CLOSING[mark]
    return spans


def quotes(text: Column | str) -> Column:
    """Column form of :func:`quote_spans`; null text has none."""

    @F.pandas_udf("array<struct<start: int, end: int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in quote_spans(t or "")])

    return run(text)


def clip_spans(spans: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """Speech of a whole text as seen from one of its chunks."""
    return [(max(a, start) - start, min(b, end) - start) for a, b in spans if a < end and b > start]


class Source:
    """A chunk with its comparison form, the places of its characters, and its speech."""

    def __init__(self, text: str, spans: list[tuple[int, int]] | None = None):
        self.text = text
        self.places = [m.start() for m in re.finditer(r"\S", text)]
        self.form = fold(text)
        self.spans = quote_spans(text) if spans is None else spans
        self.starts = [a for a, _ in self.spans]

    def narrated(self, start: int, end: int):
        """The stretches of a range of the text that are no speech."""
        for a, b in self.spans[max(0, bisect.bisect_right(self.starts, start) - 1) :]:
            if a >= end:
                break
            if a > start:
                yield start, a
            start = max(start, b)
        if start < end:
            yield start, end

    def touches_speech(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end) - 1
        return i >= 0 and self.spans[i][1] > start

    def bounds(self, first: int, last: int) -> tuple[int, int]:
        """Where characters ``first`` to ``last`` (end exclusive) of the comparison form stand in the text."""
        return self.places[first], self.places[last - 1] + 1

    def pause(self, first: int, last: int) -> int:
        start, end = self.bounds(first, last)
        own, ends = self.text[start:end], last == len(self.places)
        if (HEADING.match(own) and "\n" not in own and len(own) < T.HEADING_CHARS) or (not ends and HEADING.match(self.text, self.places[last])):
            return T.PAUSES["heading"]
        gap = self.text[end:] if ends else self.text[end : self.places[last]]
        return T.PAUSES["paragraph"] if ends or "\n\n" in gap else T.PAUSES["line"]

    def runs(self, first: int, last: int) -> list[tuple[int, int, bool]]:
        """Stretches of speech and of narration within a range of the comparison form."""
        out, (start, end) = [], self.bounds(first, last)
        place = lambda at: bisect.bisect_left(self.places, at, first, last)
        for a, b in self.narrated(start, end):
            x, y = place(a), place(b)
            if x < y:
                if first < x:
                    out.append((first, x, True))
                out.append((x, y, False))
                first = y
        return [*out, (first, last, True)] if first < last else out


def fold(text: str) -> str:
    """The comparison form; as many characters as ``text`` has that are no white space."""
    return re.sub(r"\s+", "", text).translate(str.maketrans(T.CURLY, T.STRAIGHT))


@dataclass
class Aligned:
    """``deliveries``: the segments of an answer that tells how lines sound; rows name the one they are of as ``told``."""

    rows: list[dict] = field(default_factory=list)
    warnings: list[dict] = field(default_factory=list)
    deliveries: list[dict] = field(default_factory=list)
    characters: dict = field(default_factory=dict)


class Aligner:
    """Takes segments one by one."""

    def __init__(self, source: Source, out: Aligned):
        self.source, self.out, self.cursor, self.told = source, out, 0, None

    def warn(self, text: str, reason: str) -> None:
        self.out.warnings.append({"text": text, "reason": reason})

    def row(self, first: int, last: int, speaker: str, direction: str, reaction: str, told: str | None = None) -> None:
        a, b = self.source.bounds(first, last)
        self.out.rows.append({"speaker_id": speaker, "text": self.source.text[a:b], "direction": direction, "reaction": reaction, "pause_after_ms": self.source.pause(first, last), "told": told})

    def recover(self, last: int) -> None:
        """The narrator gets everything up to ``last``."""
        a, b = self.source.bounds(self.cursor, last)
        self.warn(self.source.text[a:b], RECOVERED)
        told, self.told = self.told, None
        self.emit(last, "narrator", NARRATION, "")
        self.told = told

    def emit(self, last: int, speaker: str, direction: str, reaction: str) -> None:
        first, (a, b) = self.cursor, self.source.bounds(self.cursor, last)
        text = self.source.text[a:b]
        self.cursor = last
        if speaker != "narrator" and any(LETTER.search(self.source.text, x, y) for x, y in self.source.narrated(a, b)):
            self.warn(text, GLUED)
            for x, y, speech in self.source.runs(first, last):
                self.row(x, y, *((speaker, direction, reaction, self.told) if speech else ("narrator", NARRATION, "")))
            return
        if speaker == "narrator" and self.source.touches_speech(a, b):
            self.warn(text, QUOTED)
        self.row(first, last, speaker, direction, reaction, self.told)

    def place(self, text: str) -> int:
        """The end of a segment's text, after recovering what it skipped."""
        part, form = fold(text), self.source.form
        if part and form.startswith(part, self.cursor):
            return self.cursor + len(part)
        found = form.find(part, self.cursor) if len(part) >= LATER_CHARS else -1
        if found < 0:
            raise FidelityError(f"source fidelity mismatch at character {self.cursor}; expected {form[self.cursor : self.cursor + 80]!r}")
        self.recover(found)
        return found + len(part)

    def check_reaction(self, reaction: str, last: int) -> None:
        if not reaction:
            return
        if reaction not in T.REACTIONS:
            raise FidelityError(f"unsupported reaction: {reaction}")
        a, b = self.source.bounds(self.cursor, last)
        near = self.source.text[max(0, a - T.REACH) : b + T.REACH]
        if not T.python_pattern(T.REACTIONS[reaction]).search(near):
            raise FidelityError(f"the reaction {reaction} has no support in the source nearby")


def align(text: str, response: dict, characters: dict, spans: list[tuple[int, int]] | None = None, delivered: bool = False) -> Aligned:
    """Validate a response ``{characters, segments}`` against its source chunk.

    ``delivered``: the annotator gives ``delivery`` instead of ``direction`` and ``reaction``. It is kept as
    given, with the segment's speaker as ``told``, for ``prompts.performed`` to make a direction of.
    Errors: :class:`FidelityError`, ``RegistryError``.
    """
    segments = response.get("segments") if isinstance(response, dict) else None
    if not isinstance(segments, list) or not segments or not isinstance(response.get("characters"), list):
        raise FidelityError("a response needs characters and a non-empty list of segments")
    registry = Registry(characters)
    renamed = registry.update(response["characters"])
    out = Aligned(characters=registry.characters)
    aligner = Aligner(Source(text, spans), out)
    names = ("text", "speaker_id", "delivery") if delivered else ("text", "speaker_id", "direction", "reaction")
    for s in segments:
        if not isinstance(s, dict) or not all(isinstance(s.get(k), str) for k in names) or not isinstance(s.get("uncertain"), bool):
            raise FidelityError("invalid segment fields")
        direction, reaction = (s["delivery"], "") if delivered else (s["direction"], s["reaction"])
        if delivered:
            aligner.told = s["speaker_id"]
            out.deliveries.append({"text": s["text"], "delivery": direction, "speaker_id": s["speaker_id"]})
        last = aligner.place(s["text"])
        speaker = renamed.get(s["speaker_id"], s["speaker_id"])
        if s["uncertain"]:
            speaker = "narrator"
            aligner.warn(s["text"], UNCERTAIN)
        if speaker not in registry.characters:
            raise FidelityError(f"unknown speaker ID: {speaker}")
        aligner.check_reaction(reaction, last)
        aligner.emit(last, speaker, direction, reaction)
    aligner.told = None
    if aligner.cursor < len(aligner.source.form):
        aligner.recover(len(aligner.source.form))
    return out


ROWS = "array<struct<speaker_id: string, text: string, direction: string, reaction: string, pause_after_ms: int>>"
WARNINGS = "array<struct<text: string, reason: string>>"
_TEXT = pa.string()
ROWS_KIND = pa.list_(pa.struct([("speaker_id", _TEXT), ("text", _TEXT), ("direction", _TEXT), ("reaction", _TEXT), ("pause_after_ms", pa.int32())]))
WARNINGS_KIND = pa.list_(pa.struct([("text", _TEXT), ("reason", _TEXT)]))


def align_chunks(chunks: DataFrame, characters: dict | None = None) -> DataFrame:
    """``chunks(…, text, segments)`` with ``rows``, ``warnings`` and ``error``.

    ``segments``: array of struct(text, speaker_id, direction, reaction, uncertain). Every speaker id in
    them that ``characters`` lacks is taken as a character of its own.
    """
    names = chunks.columns

    def run(batches):
        for b in batches:
            rows, warnings, errors = [], [], []
            for source, given in zip(b.column(names.index("text")).to_pylist(), b.column(names.index("segments")).to_pylist(), strict=True):
                known = dict(characters or {"narrator": {"name": "Narrator", "aliases": []}})
                given = [s | {"uncertain": bool(s["uncertain"])} for s in given or ()]
                for s in given:
                    known.setdefault(s["speaker_id"], {"name": s["speaker_id"], "aliases": []})
                made, error = Aligned(), None
                try:
                    made = align(source or "", {"characters": [], "segments": given}, known)
                except (FidelityError, RegistryError) as e:
                    error = str(e)
                rows.append(made.rows)
                warnings.append(made.warnings)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, ROWS_KIND), pa.array(warnings, WARNINGS_KIND), pa.array(errors, _TEXT)], [*names, "rows", "warnings", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInArrow(run, f"{schema}, rows {ROWS}, warnings {WARNINGS}, error string")


def verbatim(text: Column, segments: Column) -> Column:
    """Whether an array of texts, compared, is all of a text in order; a row-local test."""
    return F.array_join(F.transform(segments, T.comparison_form), "") == T.comparison_form(text)


def cursors(segments: DataFrame, key: str, order: str) -> DataFrame:
    """``cursor`` of each segment: the characters of comparison form before it; summed by blocks of a whole number ``order``."""
    size = F.length(T.comparison_form(F.col("text"))).cast("long")
    return scripts.running_sum(segments.withColumn("n_form", size), key, order, F.col("n_form"), "cursor").withColumn("cursor", F.col("cursor").cast("long"))


def overlaps(segments: DataFrame, speech: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """Segments (``key, start, end``) with each part that is speech: ``speech_start, speech_end``.

    An interval join by buckets of ``width`` characters: both sides meet on key and bucket, and a pair
    counts in the first bucket that both reach. Empty ranges meet nothing.
    """
    buckets = lambda df: df.where(F.col("start") < F.col("end")).withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    other = buckets(speech.select(F.col(key).alias("_k"), "start", "end")).select("_k", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("_b").alias("_o"))
    met = buckets(segments).join(other, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_o")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")))
    once = met.where(F.col("_b") == F.floor(F.greatest("start", "_s") / width))
    return once.select(*segments.columns, F.greatest("start", "_s").alias("speech_start"), F.least("end", "_e").alias("speech_end"))
