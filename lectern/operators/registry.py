"""Character registry: one entry for all names of a character.

:class:`Registry` takes updates in order, as later ones see the names of earlier ones. Books are
independent: :func:`merge_books` runs it per book, whose characters are few. :func:`link_aliases` is one
round of it for any number of books, by joins and aggregates alone. :func:`overlay` lays an edited sheet
over the characters found.
"""

from __future__ import annotations

import copy
import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

PROFILE = ("gender_evidence", "age", "voice", "personality")
NARRATOR = {"name": "Narrator", "aliases": [], "gender": "unknown"}

#: Characters that a task hands on together.
MOST_ROWS = 10_000


class RegistryError(ValueError):
    """Character data that can't be used."""


def parse_gender(value) -> str:
    """Python form of ``functions.text.gender``; an error instead of null."""
    if value is None or value == "":
        return "unknown"
    known = T.GENDERS.get(value.strip().casefold()) if isinstance(value, str) else None
    if known is None:
        raise RegistryError("gender must be male, female, or unknown")
    return known


class Registry:
    """Characters by id, and the id of every name, compared without case."""

    def __init__(self, characters: dict | None = None):
        self.characters = copy.deepcopy(characters or {})
        self.owner: dict[str, str] = {}
        for sid, c in self.characters.items():
            c.setdefault("gender", "unknown")
            self.claim(sid, [sid, c["name"], *c["aliases"]])

    def claim(self, sid: str, names: list[str]) -> None:
        self.owner.update((n.casefold(), sid) for n in names)

    def update(self, items: list) -> dict[str, str]:
        """Merge items in order; the registry's id for each item's own id."""
        return {item["speaker_id"]: self.one(item) for item in map(self.checked, items)}

    def checked(self, item) -> dict:
        if not isinstance(item, dict) or not isinstance(item.get("name"), str) or not item["name"].strip():
            raise RegistryError("invalid character name")
        sid, names = item.get("speaker_id"), item.get("aliases")
        if not isinstance(sid, str) or not re.fullmatch(T.SPEAKER_ID, sid) or not isinstance(names, list) or not all(isinstance(n, str) for n in names):
            raise RegistryError("invalid character ID or aliases")
        if sid in T.PRONOUNS:
            raise RegistryError("a character ID must be a name, not a pronoun")
        for k in PROFILE:
            v = item.get(k)
            if v is not None and (not isinstance(v, str) or (k == "age" and v not in T.AGES)):
                raise RegistryError(f"invalid character {k}")
        return item | {"aliases": [n for n in names if n.strip().casefold() not in T.PRONOUNS], "gender": parse_gender(item.get("gender"))}

    def one(self, item: dict) -> str:
        sid = item["speaker_id"]
        names = [sid, item["name"], *item["aliases"]]
        owners = {self.owner[n.casefold()] for n in names if n.casefold() in self.owner}
        if len(owners) > 1:
            raise RegistryError("aliases belong to several speakers")
        own = owners.pop() if owners else sid
        if own == "narrator" != sid:
            raise RegistryError("a character cannot alias the narrator")
        entry = self.characters.setdefault(own, {"name": item["name"], "aliases": [], "gender": "unknown"})
        entry["aliases"] = sorted({*entry["aliases"], *item["aliases"], *(names[:2] if own != sid else [])})
        if entry["gender"] == "unknown":
            entry["gender"] = item["gender"]
        for k in PROFILE:
            new = (item.get(k) or "").strip()
            if new and entry.get(k, "unknown") in ("", "unknown"):
                entry[k] = new
        self.claim(own, names)
        return own


def _walked(updates: DataFrame, made, columns: str, kinds: list[pa.DataType]) -> DataFrame:
    """``book_id`` and ``columns``, the rows that ``made(registry, renamed, error)`` gives of every book.

    A book's updates come one after the other, so a task holds the characters of one book and not its updates.
    """
    rows = updates.select("book_id", "nth", F.to_json("item").alias("item")).repartition("book_id").sortWithinPartitions("book_id", "nth", "item")

    def run(batches):
        registry, renamed, error, book, began, out = None, {}, None, None, False, []

        def parts(most: int):
            while len(out) >= most and out:
                some, out[:] = out[:MOST_ROWS], out[MOST_ROWS:]
                ids = pa.array([r[0] for r in some], kind)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[i] for r in some], k) for i, k in enumerate(kinds, 1)]], names)

        for b in batches:
            kind = b.column(0).type
            for own, item in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not began or own != book:
                    if began:
                        out.extend((book, *r) for r in made(registry, renamed, error))
                        yield from parts(MOST_ROWS)
                    registry, renamed, error, book, began = Registry({"narrator": NARRATOR}), {}, None, own, True
                if error is None:
                    try:
                        one = registry.checked(json.loads(item))
                        renamed[one["speaker_id"]] = registry.one(one)
                    except RegistryError as e:
                        error = str(e)
        if began:
            out.extend((book, *r) for r in made(registry, renamed, error))
            yield from parts(0)

    names = ["book_id", *[c.strip().split(" ")[0] for c in columns.split("; ")]]
    return rows.mapInArrow(run, f"book_id {updates.schema['book_id'].dataType.simpleString()}, {columns.replace('; ', ', ')}")


def merge_books(updates: DataFrame) -> DataFrame:
    """``book_id, characters`` (JSON by id) ``, renamed`` (map) ``, error`` from ``updates(book_id, nth, item)``.

    ``item``: struct with ``speaker_id, name, aliases`` and, if known, ``gender`` and profile fields. A
    book is one row; see :func:`merge_characters` for casts that are large.
    """

    def made(registry, renamed, error):
        yield (None, None, error) if error else (json.dumps(registry.characters, ensure_ascii=False, sort_keys=True), list(renamed.items()), None)

    return _walked(updates, made, "characters string; renamed map<string, string>; error string", [pa.string(), pa.map_(pa.string(), pa.string()), pa.string()])


def merge_characters(updates: DataFrame) -> DataFrame:
    """:func:`merge_books` with a row for each character: ``book_id, speaker_id, character`` (JSON) ``, items, error``.

    ``items``: how many ids of updates are this character's. A book that fails is one row with ``error``.
    """

    def made(registry, renamed, error):
        if error:
            yield None, None, None, error
            return
        items = Counter(renamed.values())
        for sid, c in registry.characters.items():
            yield sid, json.dumps(c, ensure_ascii=False, sort_keys=True), items[sid], None

    return _walked(updates, made, "speaker_id string; character string; items int; error string", [pa.string(), pa.string(), pa.int32(), pa.string()])


def link_aliases(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """One round by joins: ``book_id, speaker_id, canonical, owners`` (more than one: an error) ``, aliases``.

    ``registry`` and ``updates``: ``book_id, speaker_id, name, aliases``. Names are compared in lower case;
    pronouns are no aliases.
    """

    def names(df: DataFrame) -> DataFrame:
        kept = F.filter("aliases", lambda n: ~F.lower(T.strip(n)).isin(*T.PRONOUNS))
        return df.withColumn("aliases", kept).withColumn("all", F.concat(F.array("speaker_id", "name"), kept))

    known = names(registry).select("book_id", F.col("speaker_id").alias("owner"), F.col("aliases").alias("had"), F.explode(F.array_distinct(F.transform("all", F.lower))).alias("key"))
    new = names(updates)
    asked = new.select("book_id", "speaker_id", F.explode(F.array_distinct(F.transform("all", F.lower))).alias("key"))
    # the owners of one speaker's names: partial sets before the shuffle
    hits = asked.join(known, ["book_id", "key"]).groupBy("book_id", "speaker_id").agg(F.sort_array(F.collect_set("owner")).alias("owners"), F.min_by("had", "owner").alias("had"))
    both = new.join(hits, ["book_id", "speaker_id"], "left")
    found = F.coalesce(F.size("owners"), F.lit(0))
    number = F.greatest(found, F.lit(0)).cast("long")
    own = F.coalesce(F.element_at("owners", 1), F.col("speaker_id"))
    renamed = own != F.col("speaker_id")
    none = F.array().cast("array<string>")
    union = F.array_sort(F.array_distinct(F.concat(F.coalesce("had", none), "aliases", F.when(renamed, F.array("name", "speaker_id")).otherwise(none))))
    return both.select("book_id", "speaker_id", own.alias("canonical"), number.alias("owners"), union.alias("aliases"))


def overlay(characters: DataFrame, sheet: DataFrame) -> DataFrame:
    """Characters under an edited sheet, by ``book_id, speaker_id``: the sheet's values win where they hold something.

    A sheet's unknown gender never hides a known one. Columns: ``name, aliases, gender, age, voice``.
    """
    keys = ["book_id", "speaker_id"]
    left = characters.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("name", "aliases", "gender", "age", "voice")])
    both = left.join(sheet, keys, "full")
    text = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.nullif(F.col("_" + c), F.lit(""))).alias(c)
    listed = lambda c: F.when(F.size(c) > 0, F.col(c))
    known = lambda c: F.nullif(T.gender(F.col(c)), F.lit("unknown"))
    return both.select(*keys, text("name"), F.coalesce(listed("aliases"), listed("_aliases")).alias("aliases"), F.coalesce(known("gender"), known("_gender"), F.lit("unknown")).alias("gender"), text("age"), text("voice"))
