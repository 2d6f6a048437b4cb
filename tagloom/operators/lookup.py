"""Name lookups (J1-J7, J13): one row per key, and facts about the texts of a catalogue.

Names repeat, so nothing is searched row by row. The distinct texts of the wanted
fields are taken first, each is folded and cut into its parts once, the parts meet
the lookup in one equi-join, and what they hit is folded back to one row of facts
per text. Rows then get the facts by an equi-join on the text itself. Only texts
that hit anything have a row, so the table is small where names are few. Texts that
hardly repeat (titles, file names) meet the lookup before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions import text as X
from tagloom.functions.keys import folder_lookup_key, name_key, name_key_of, ngram_keys, token_keys_of
from tagloom.operators.lineage import settle, settle_each
from tagloom.sources.dictionary import Dictionary

# Keys up to which every task gets the whole lookup; beyond, Catalyst joins by size.
BROADCAST_KEYS = 200_000

NAME_COLUMNS = [
    "composer", "person", "conductor", "ens_id", "ens_canonical", "ens_split", "ens_no_conductor", "ens_eras",
]
# Parts of a text that can be asked for: the whole value, its tokens by the dictionary's or
# the finder's separators, and its runs of up to three tokens.
WHOLE, DICTIONARY_TOKEN, FINDER_TOKEN, GRAM = "w", "d", "f", "g"


def dict_names(dictionary: Dictionary) -> DataFrame:
    """Every registered name with its key: category, ord, seq, owner columns, name, source."""

    def element(source: str):
        return lambda name: F.struct(F.lit(source).alias("source"), name.alias("name"))

    def exploded(table: DataFrame, category: str) -> DataFrame:
        parts = [
            F.array(element("canonical")(F.col("canonical"))),
            F.transform("aliases", element("alias")),
            F.transform("aliases_ja", element("alias_ja")),
        ]
        keep, owner = ["canonical"], F.col("canonical")
        if category == "ensemble":
            parts.insert(0, F.transform("eras", lambda e: element("era")(e["canonical"])))
            keep, owner = ["canonical", "eras", "entity_id"], ensemble_label()
        rows = table.select("ord", *keep, F.posexplode(F.concat(*parts)).alias("seq", "n"))
        return rows.select(
            F.lit(category).alias("category"), "ord", "seq", owner.alias("canonical"),
            F.col("n.source").alias("source"), F.col("n.name").alias("name"), name_key(F.col("n.name")).alias("key"),
        ).filter("name is not null")

    tables = {"composer": dictionary.composers, "person": dictionary.persons, "ensemble": dictionary.ensembles}
    return reduce(DataFrame.unionByName, [exploded(t, c) for c, t in tables.items()])


def ensemble_label() -> Column:
    """First usable name of an ensemble row, else its id."""
    names = F.concat(F.array("canonical"), F.transform("eras", lambda e: e["canonical"]))
    return F.coalesce(F.get(F.filter(names, lambda n: F.trim(n) != ""), F.lit(0)), F.col("entity_id"))


def build_lookup(dictionary: Dictionary) -> DataFrame:
    """One row per key with what each category registered first under it."""
    names = dict_names(dictionary).filter("key <> ''")
    roles = dictionary.persons.select(
        "ord", F.exists("roles", lambda r: F.lower(r) == "conductor").alias("conductor")
    )
    owners = (
        names.join(roles.withColumn("category", F.lit("person")), ["category", "ord"], "left")
        .join(
            dictionary.ensembles.select(
                F.lit("ensemble").alias("category"), "ord", "entity_id", "no_era_split", "no_conductor",
                F.col("canonical").alias("ens_name"), "eras",
            ),
            ["category", "ord"],
            "left",
        )
    )
    surnames = (
        dictionary.composers.select(
            F.explode(
                F.concat(
                    F.array(F.substring_index(F.trim("canonical"), " ", -1)),
                    F.filter("aliases", lambda a: ~F.contains(a, F.lit(" "))),
                )
            ).alias("name")
        )
        .select(name_key(F.col("name")).alias("key"))
        .filter("key <> ''")
    )
    protected = dictionary.protected.select(name_key(F.col("value")).alias("key")).filter("key <> ''")
    at = F.struct("ord", "seq")
    facts = owners.select(
        "key",
        F.when(F.col("category") == "composer", F.struct(at.alias("at"), "canonical")).alias("c"),
        F.when(F.col("category") == "person", F.struct(at.alias("at"), "canonical", "conductor")).alias("p"),
        F.when(
            F.col("category") == "ensemble",
            F.struct(
                at.alias("at"), "entity_id", "ens_name", "canonical", "no_era_split", "no_conductor", "eras"
            ),
        ).alias("e"),
        F.lit(False).alias("surname"),
        F.lit(False).alias("protected"),
    )
    marks = surnames.withColumn("surname", F.lit(True)).unionByName(
        protected.withColumn("protected", F.lit(True)), allowMissingColumns=True
    )
    merged = facts.unionByName(marks, allowMissingColumns=True).groupBy("key").agg(
        F.min("c").alias("c"), F.min("p").alias("p"), F.min("e").alias("e"),
        F.max(F.coalesce("surname", F.lit(False))).alias("surname"),
        F.max(F.coalesce("protected", F.lit(False))).alias("protected"),
    )
    return merged.select(
        "key",
        F.col("c.canonical").alias("composer"),
        "surname",
        F.col("p.canonical").alias("person"),
        F.coalesce("p.conductor", F.lit(False)).alias("conductor"),
        F.col("e.entity_id").alias("ens_id"),
        F.col("e.ens_name").alias("ens_canonical"),
        F.col("e.canonical").alias("ens_label"),
        F.coalesce(F.size("e.eras") > 0, F.lit(False)).alias("ens_has_eras"),
        F.coalesce((F.size("e.eras") > 0) & ~F.col("e.no_era_split"), F.lit(False)).alias("ens_split"),
        F.coalesce("e.no_conductor", F.lit(False)).alias("ens_no_conductor"),
        F.col("e.eras").alias("ens_eras"),
        "protected",
    )


def probes(values: DataFrame, parts: dict[str, str]) -> DataFrame:
    """(field, value, p) with p (i, j, part, key) of the parts of the values; ``parts`` has the wanted ones of each field.

    The texts are rows before their keys are made: a column is compiled, a lambda is interpreted."""
    made = {
        WHOLE: F.array(name_key_of("_text")),
        DICTIONARY_TOKEN: token_keys_of("_text", X.DICTIONARY_SEPARATORS),
        FINDER_TOKEN: token_keys_of("_text", X.FINDER_SEPARATORS),
        GRAM: ngram_keys(F.col("_text"), X.FINDER_SEPARATORS),
    }
    keys = []
    for part, of_text in made.items():
        fields = [f for f, wanted in parts.items() if part in wanted]
        if fields:
            wanted = F.when(F.col("field").isin(fields), of_text)
            keys.append(F.struct(F.lit(part).alias("part"), F.lit(0 if part == WHOLE else 1).alias("first"), wanted.alias("keys")))
    texts = values.select("field", "value", F.posexplode("value").alias("i", "_text"))
    by_part = texts.select("field", "value", "i", F.array(*keys).alias("_parts")).select("field", "value", "i", F.inline_outer("_parts"))
    each = by_part.select("field", "value", "i", "part", "first", F.posexplode("keys").alias("j", "key"))
    return each.select("field", "value", F.struct("i", (F.col("j") + F.col("first")).alias("j"), "part", "key").alias("p"))


def _is(part: str, h: Column) -> Column:
    return h["part"] == part


def _performer(h: Column) -> Column:
    return h["person"].isNotNull() | h["ens_id"].isNotNull()


def facts_of(hits: Column, values: Column) -> dict[str, Column]:
    """What the hits (in the order of the text) say of the values they come from."""

    def blocked(h: Column) -> Column:
        """Is the value that the hit lies in a performer as a whole?"""
        return F.exists(hits, lambda b: _is(WHOLE, b) & (b["i"] == h["i"]) & _performer(b))

    def first(test) -> Column:
        return F.get(F.filter(hits, test), F.lit(0))

    contained = first(
        lambda h: h["composer"].isNotNull() & (_is(WHOLE, h) | (_is(DICTIONARY_TOKEN, h) & h["surname"])) & ~blocked(h)
    )
    plain = first(lambda h: _is(WHOLE, h) & h["ens_id"].isNotNull() & ~h["ens_has_eras"] & h["ens_canonical"].isNotNull())
    others = F.filter(hits, lambda h: _is(FINDER_TOKEN, h) & h["composer"].isNotNull() & ~_performer(h) & ~blocked(h))
    whole = first(lambda h: _is(WHOLE, h))
    return {
        # the entries of a field's only value
        **{c: F.when(F.size(values) == 1, whole[c]) for c in NAME_COLUMNS},
        "protected": F.exists(hits, lambda h: _is(WHOLE, h) & h["protected"]),
        # A text that is itself a performer is passed over; else the whole, else its first surname
        "contained_key": contained["key"],
        "contained": contained["composer"],
        "plain_ensemble": plain["ens_canonical"],
        "listed_ensemble": F.exists(hits, lambda h: _is(WHOLE, h) & h["ens_id"].isNotNull()),
        "first_conductor": first(lambda h: _is(WHOLE, h) & h["conductor"])["person"],
        # J8, J9, J11
        "gram_conductor": first(lambda h: _is(GRAM, h) & h["conductor"])["person"],
        "first_composer": first(lambda h: (_is(WHOLE, h) | _is(FINDER_TOKEN, h)) & h["composer"].isNotNull())["composer"],
        "others": F.array_distinct(F.transform(others, lambda h: h["composer"])),
    }


def other_than(others: Column, own: Column) -> Column:
    """The first of the composers that is not the row's own."""
    return F.get(F.filter(others, lambda c: ~c.eqNullSafe(own)), F.lit(0))


def join_facts(df: DataFrame, facts: DataFrame, fields: dict[str, Column], *names: str) -> DataFrame:
    """Left join of the facts ``names`` (all by default) of each field's value as ``{field}_{name}``."""
    wanted = names or [c for c in facts.columns if c not in ("field", "value")]
    for name, value in fields.items():
        own = facts.filter(F.col("field") == name).select(
            F.col("value").alias(f"{name}__value"), *[F.col(c).alias(f"{name}_{c}") for c in wanted]
        )
        # An empty field has no facts; its null key meets nothing. The key is a column, as in ``resolve``.
        asked = df.withColumn(f"{name}__asked", F.when(F.size(value) > 0, value))
        df = asked.join(own, F.col(f"{name}__asked") == F.col(f"{name}__value"), "left").drop(f"{name}__asked", f"{name}__value")
    return df


@dataclass
class Index:
    """Lookup tables of one dictionary version; ``lookup`` is a written table of ``keys`` rows."""

    dictionary: Dictionary
    lookup: DataFrame
    keys: int
    typos: list[tuple[str, str]]
    overridden: bool
    has_works: bool
    _works: DataFrame | None = field(default=None)

    @classmethod
    def build(cls, dictionary: Dictionary) -> "Index":
        lookup = settle(build_lookup(dictionary), "lookup")
        return cls(
            dictionary=dictionary,
            lookup=lookup,
            keys=lookup.count(),
            typos=valid_typos(dictionary),
            overridden=not dictionary.overrides.isEmpty(),
            has_works=not dictionary.works.isEmpty(),
        )

    # ---- whole-value lookups -------------------------------------------------

    def _sized(self, names: DataFrame) -> DataFrame:
        return F.broadcast(names) if self.keys <= BROADCAST_KEYS else names

    def resolve(self, df: DataFrame, key: Column, prefix: str, *columns: str) -> DataFrame:
        """Left join of the chosen lookup columns as ``{prefix}_{column}``.

        The lookup goes to every task while its counted size allows, else Catalyst
        plans a join that adaptive execution can split on hot keys."""
        renamed = self.lookup.select(
            F.col("key").alias(f"{prefix}_key"), *[F.col(c).alias(f"{prefix}_{c}") for c in columns]
        )
        # A blank text has no key; null keys never match and add no skew in a broadcast join. The key is
        # a column, as a sort for a join makes its expressions again in every comparison.
        probe = f"_{prefix}_probe"
        keyed = df.withColumn(probe, F.nullif(key, F.lit("")))
        return keyed.join(self._sized(renamed), F.col(probe) == F.col(f"{prefix}_key"), "left").drop(probe)

    # ---- facts about texts -----------------------------------------------------

    def facts(
        self, rows: DataFrame, fields: dict[str, tuple[Column, str]], rare: tuple[str, ...] = (),
        of_column: dict[str, str] | None = None,
    ) -> DataFrame:
        """(field, value, facts) of the distinct values of the fields that hit the lookup.

        ``fields`` has, by name, an array of texts and the parts to ask for; the values
        of those in ``rare`` hardly repeat. Those in ``of_column`` are made of that one
        column of the rows, so they are made once for each of its distinct texts."""
        source = {f: c for f, c in (of_column or {}).items() if f in fields}
        common = {f: x for f, x in fields.items() if f not in rare and f not in source}
        groups = [(rows, common, True), (rows, {f: fields[f] for f in rare if f in fields}, False)]
        for column in dict.fromkeys(source.values()):
            groups.append((rows.select(column).distinct(), {f: fields[f] for f, c in source.items() if c == column}, True))
        hits = [
            self._hits(self._values(of, part, distinct), {f: parts for f, (_, parts) in part.items()})
            for of, part, distinct in groups
            if part
        ]
        grouped = reduce(DataFrame.unionByName, hits).groupBy("field", "value").agg(F.array_sort(F.collect_set("hit")).alias("hits"))
        return grouped.select("field", "value", *[c.alias(n) for n, c in facts_of(F.col("hits"), F.col("value")).items()])

    @staticmethod
    def _values(rows: DataFrame, fields: dict[str, tuple[Column, str]], distinct: bool) -> DataFrame:
        pairs = [F.struct(F.lit(f).alias("field"), value.alias("value")) for f, (value, _) in fields.items()]
        out = rows.select(F.inline(F.array(*pairs))).filter("size(value) > 0")
        return out.distinct() if distinct else out

    def _hits(self, values: DataFrame, parts: dict[str, str]) -> DataFrame:
        asked = probes(values, parts)
        names = self.lookup.withColumnRenamed("key", "_key")
        found = asked.filter("p.key <> ''").join(self._sized(names), F.col("p.key") == F.col("_key"))
        # only hits that a fact can come of are shuffled
        found = found.filter(
            f"p.part = '{WHOLE}' or (p.part = '{GRAM}' and conductor)"
            f" or (composer is not null and (p.part = '{FINDER_TOKEN}' or (p.part = '{DICTIONARY_TOKEN}' and surname)))"
        )
        hit = F.struct(
            "p.i", "p.j", "p.part", "p.key", "surname", "protected", "ens_has_eras", *NAME_COLUMNS
        )
        return found.select("field", "value", hit.alias("hit"))

    def with_facts(self, df: DataFrame, fields: dict[str, tuple[Column, str]], *names: str) -> DataFrame:
        """Adds the facts ``names`` of each field's value as ``{field}_{name}``. The facts are written
        first, as each field joins its own; ``df`` is read for them too, so it should be cheap to read."""
        known = settle_each(self.facts(df, fields), "facts", "field", list(fields))
        for name, (value, _) in fields.items():
            df = join_facts(df, known[name], {name: value}, *names)
        return df

    # ---- works, overrides, eras ----------------------------------------------

    @property
    def works(self) -> DataFrame:
        """(composer, key) -> work, first registration wins."""
        if self._works is None:
            names = F.concat(F.array("canonical"), "aliases", "aliases_ja")
            self._works = (
                self.dictionary.works.filter("trim(composer) <> '' and trim(canonical) <> ''")
                .select("ord", "composer", "canonical", F.posexplode(names).alias("seq", "name"))
                .select(
                    F.col("composer").alias("work_composer"), name_key(F.col("name")).alias("work_key"),
                    F.struct("ord", "seq", "canonical").alias("w"),
                )
                .filter("work_key <> ''")
                .groupBy("work_composer", "work_key")
                .agg(F.min("w").alias("w"))
                .select("work_composer", "work_key", F.col("w.canonical").alias("work"))
            )
        return self._works

    def with_override(self, units: DataFrame, folder: str = "folder", disc: str = "disc") -> DataFrame:
        """Adds ``override`` (struct or null); a row for the disc beats one for the folder."""
        fields = ["composer", "work_name", "date", "exclude", "note"]
        kind = "struct<composer:string,work_name:string,date:string,exclude:boolean,note:string>"
        if not self.overridden:
            return units.withColumn("override", F.lit(None).cast(kind))
        ov = (
            self.dictionary.overrides.filter("trim(folder) <> ''")
            .withColumn("_ov_folder", folder_lookup_key(F.col("folder")))
            .groupBy("_ov_folder", F.col("disc").alias("_ov_disc"))
            .agg(F.min_by(F.struct(*fields), "ord").alias("_ov"))
        )
        exact = ov.filter("_ov_disc is not null").withColumnRenamed("_ov", "_exact")
        whole = ov.filter("_ov_disc is null").select(
            F.col("_ov_folder").alias("_ov_folder2"), F.col("_ov").alias("_whole")
        )
        keyed = units.withColumn("_folder_nfc", folder_lookup_key(F.col(folder)))
        return (
            keyed.join(exact, (F.col("_folder_nfc") == F.col("_ov_folder")) & (F.col(disc) == F.col("_ov_disc")), "left")
            .join(whole, F.col("_folder_nfc") == F.col("_ov_folder2"), "left")
            .withColumn("override", F.coalesce("_exact", "_whole"))
            .drop("_folder_nfc", "_ov_folder", "_ov_disc", "_exact", "_ov_folder2", "_whole")
        )


def era_name(eras: Column, year: Column) -> Column:
    """Name of the first era that covers the year; null means hold.

    The eras of an ensemble are a short list, so the interval test stays inside
    the row instead of a range join."""
    covering = F.filter(
        eras,
        lambda e: (e["from_year"].isNull() | (year >= e["from_year"]))
        & (e["until_year"].isNull() | (year < e["until_year"])),
    )
    return F.when(year.isNotNull(), F.get(covering, F.lit(0))["canonical"])


def valid_typos(dictionary: Dictionary) -> list[tuple[str, str]]:
    """The typo patterns in order, without the blank and the malformed ones."""
    rows = dictionary.typos.orderBy("ord").select("pattern", "replacement").collect()
    spark = dictionary.typos.sparkSession
    return [(r[0], r[1] or "") for r in rows if is_valid_pattern(spark, r[0])]


def is_valid_pattern(spark, pattern: str | None) -> bool:
    if pattern is None or not pattern.strip():
        return False
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:
        return False
