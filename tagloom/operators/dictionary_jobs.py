"""Jobs on the dictionary itself.

Everything is keyed joins and aggregates on the seven tables, so a dictionary
made of millions of entries is checked the same way as a small one."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tagloom.functions import text as X
from tagloom.functions.keys import folder_lookup_key, let, name_key, name_keys
from tagloom.operators.lineage import settle
from tagloom.operators.lookup import dict_names, ensemble_label, is_valid_pattern
from tagloom.operators.ordering import numbered_within
from tagloom.sources.dictionary import Dictionary

ROLES = ["conductor", "soloist"]
BLANK = "(blank)"
NEAR = 3


def _blank(column: str) -> Column:
    return X.is_blank(F.col(column))


def canonicals(dictionary: Dictionary) -> DataFrame:
    """Distinct canonical names per category."""
    names = dict_names(dictionary).filter(F.col("source").isin("canonical", "era"))
    return names.filter("trim(name) <> ''").select("category", "name").distinct()


def already_known(values: DataFrame, column: str, lookup: DataFrame) -> DataFrame:
    """Owner of a value, categories in the order composer, person, ensemble."""
    keyed = values.withColumn("_key", name_key(F.col(column)))
    hit = keyed.join(lookup.withColumnRenamed("key", "_lk"), F.col("_key") == F.col("_lk"), "left")
    return hit.select(
        *values.columns,
        F.when(F.col("composer").isNotNull(), "composer").when(F.col("person").isNotNull(), "person")
        .when(F.col("ens_id").isNotNull(), "ensemble").alias("known_category"),
        F.coalesce("composer", "person", "ens_label").alias("known_owner"),
    )


def search_rows(rows: DataFrame, query: str) -> DataFrame:
    """Rows whose text contains the query, ignoring case."""
    texts = [F.col(c).cast("string") for c in rows.columns]
    return rows.filter(F.contains(F.upper(F.concat_ws("\n", *texts)), F.upper(F.lit(query))))


# ---- validation (W10) -------------------------------------------------------------------------


def _issue(df: DataFrame, severity, category, target, code, detail=None) -> DataFrame:
    def col(x):
        return F.lit(x) if isinstance(x, str) else x

    return df.select(
        col(severity).alias("severity"), col(category).alias("category"), col(target).alias("target"),
        col(code).alias("code"), (F.lit("") if detail is None else F.coalesce(detail, F.lit(""))).alias("detail"),
    )


def _owned_names(dictionary: Dictionary) -> DataFrame:
    """Names with their owner's label; era names of one ensemble once per key."""
    names = dict_names(dictionary).filter(~((F.col("category") != "ensemble") & _blank("canonical")))
    era_repeat = Window.partitionBy("category", "ord", "source", "key").orderBy("seq")
    return (
        names.withColumn("_nth", F.row_number().over(era_repeat))
        .filter("source <> 'era' or _nth = 1")
        .select("category", "ord", "seq", F.col("canonical").alias("owner"), "name", "key")
    )


def _name_issues(names: DataFrame) -> list[DataFrame]:
    keyed = names.filter("key <> ''")
    first = keyed.groupBy("category", "key").agg(
        F.min(F.struct("ord", "seq", "owner")).alias("first")
    )
    later = keyed.join(first, ["category", "key"]).filter(
        F.struct("ord", "seq") != F.struct(F.col("first.ord"), F.col("first.seq"))
    )
    same = F.col("owner") == F.col("first.owner")
    clash = _issue(
        later, F.when(same, "warning").otherwise("error"), F.col("category"), F.col("owner"),
        F.when(same, "alias_repeated").otherwise("alias_used"),
        F.when(same, F.col("name")).otherwise(F.concat_ws(" <- ", "name", "first.owner")),
    )
    empty = _issue(names.filter("key = ''"), "warning", F.col("category"), F.col("owner"), "alias_empty", F.col("name"))
    owners = first.select("key", "category", F.col("first.owner").alias("owner"))
    rank = F.when(F.col("category") == "composer", 0).when(F.col("category") == "person", 1).otherwise(2)
    left, right = owners.withColumn("rank", rank), owners.withColumn("rank", rank)
    crossed = left.alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.rank") < F.col("r.rank")))
    cross = _issue(
        crossed, "warning", F.col("l.category"), F.col("l.owner"), "also_in_category",
        F.concat_ws(": ", "r.category", "r.owner"),
    )
    return [clash, empty, cross]


def _ensemble_issues(ensembles: DataFrame) -> list[DataFrame]:
    label = F.coalesce("canonical", F.get("eras", F.lit(0))["canonical"], "entity_id")
    df = ensembles.withColumns({"label": label, "n_eras": F.size("eras"), "named": ~_blank("canonical")})
    nothing = ~F.col("named") & (F.col("n_eras") == 0)
    first = df.filter(~_blank("entity_id")).groupBy(F.lower("entity_id").alias("id")).agg(F.min("ord").alias("first"))
    repeated = df.join(first, F.lower("entity_id") == F.col("id")).filter("ord <> first")
    eras = df.select("ord", "label", F.posexplode("eras").alias("pos", "e")).select("ord", "label", "pos", "e.*")
    period = F.concat(
        F.coalesce("canonical", F.lit("")), F.lit(" ("), F.coalesce(F.col("from_year").cast("string"), F.lit("")),
        F.lit("~"), F.coalesce(F.col("until_year").cast("string"), F.lit("")), F.lit(")"),
    )
    order = Window.partitionBy("ord").orderBy(
        F.col("from_year").asc_nulls_first(), F.col("until_year").asc_nulls_last(), "pos"
    )
    # Each era against the next; a missing end is open, a missing start too.
    steps = (
        eras.withColumn("period", period)
        .withColumns({
            "next_period": F.lead("period").over(order),
            "next_start": F.lead(F.coalesce("from_year", F.lit(-2147483648))).over(order),
            "end": F.coalesce("until_year", F.lit(2147483647)),
        })
        .filter("next_period is not null and next_start <> end")
    )
    return [
        _issue(df.filter(_blank("entity_id")), "error", "ensemble", F.col("label"), "entity_id_missing"),
        _issue(repeated, "error", "ensemble", F.col("label"), "entity_id_repeated", F.col("entity_id")),
        _issue(df.filter(nothing), "error", "ensemble", F.col("label"), "no_name"),
        _issue(df.filter(~nothing & F.col("no_era_split") & ~F.col("named")), "error", "ensemble", F.col("label"), "no_split_without_name"),
        _issue(
            df.filter(F.col("named") & (F.col("n_eras") > 0) & ~F.col("no_era_split")), "warning", "ensemble",
            F.col("label"), "name_and_eras",
        ),
        _issue(eras.filter(_blank("canonical")), "error", "ensemble", F.col("label"), "era_name_empty", period),
        _issue(
            steps, "warning", "ensemble", F.col("label"),
            F.when(F.col("next_start") < F.col("end"), "eras_overlap").otherwise("eras_gap"),
            F.concat_ws(" / ", "period", "next_period"),
        ),
    ]


def work_label() -> Column:
    name = F.when(_blank("canonical"), BLANK).otherwise(F.col("canonical"))
    return F.when(_blank("composer"), name).otherwise(F.concat_ws(": ", "composer", name))


def nearest_composers(dictionary: Dictionary) -> DataFrame:
    """Works whose composer is no canonical name, with the closest one within
    three edits.

    Of a name cut into four, three edits leave a part whole, and the edits before and
    behind it bound how far it has moved. So candidates come from an equi-join of the
    parts of each distinct name with a few substrings of each distinct unknown one,
    instead of comparing every pair."""
    composers = dictionary.composers.select(F.col("ord").alias("c_ord"), F.col("canonical").alias("c"))
    orphans = (
        dictionary.works.filter(~_blank("composer"))
        .join(composers, F.col("composer") == F.col("c"), "left_anti")
        .select("ord", "composer", "canonical")
    )

    def pieces(text: Column, n: Column, moved: Column | None) -> Column:
        """Of a text cut into four for length n: (n, part, piece). With ``moved`` (its
        own length less n), every start that the part can have moved to."""
        size = F.floor(n / 4).cast("int")

        def part(i: Column) -> Column:
            start = i * size + 1
            width = F.when(i == 3, n - 3 * size).otherwise(size)
            if moved is None:
                shifts = F.array(F.lit(0))
            else:
                low, high = F.greatest(-i, moved - (NEAR - i)), F.least(i, moved + (NEAR - i))
                shifts = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            return F.transform(
                F.filter(shifts, lambda d: start + d >= 1),
                lambda d: F.struct(n.alias("n"), i.alias("i"), F.substr(text, start + d, width).alias("piece")),
            )

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), part))

    names = composers.groupBy("c").agg(F.min("c_ord").alias("c_ord"))
    asked = orphans.select("composer").distinct()
    index = names.select("c_ord", "c", F.explode(pieces(F.col("c"), F.length("c"), None)).alias("p"))
    own = F.length("composer")
    lengths = F.sequence(F.greatest(own - NEAR, F.lit(0)), own + NEAR)
    probes = asked.select(
        "composer",
        F.explode(F.array_distinct(F.flatten(F.transform(lengths, lambda n: pieces(F.col("composer"), n, own - n))))).alias("q"),
    )
    pairs = (
        probes.join(index, F.col("q") == F.col("p"))
        .select("composer", "c_ord", "c").distinct()
        .withColumn("d", F.levenshtein("composer", "c", NEAR))
        .filter("d >= 0")
    )
    best = pairs.groupBy("composer").agg(F.min(F.struct("d", "c_ord", "c")).alias("b"))
    return orphans.join(best, "composer", "left").select(
        "ord", "composer", "canonical", F.col("b.c").alias("closest"),
        F.when(F.col("b.c").isNotNull(), X.first_difference(F.col("composer"), F.col("b.c"))).alias("differs_at"),
    )


def _work_issues(dictionary: Dictionary) -> list[DataFrame]:
    works = dictionary.works.withColumn("label", work_label())
    usable = works.filter(~_blank("composer") & ~_blank("canonical"))
    first = usable.groupBy("composer", "canonical").agg(F.min("ord").alias("first"))
    repeated = usable.join(first, ["composer", "canonical"]).filter("ord <> first")
    names = usable.select(
        "ord", "label", "composer", "canonical",
        F.posexplode(F.concat(F.array("canonical"), "aliases", "aliases_ja")).alias("seq", "name"),
    ).withColumn("key", name_key(F.col("name")))
    keyed = names.filter("key <> ''")
    owner = keyed.groupBy("composer", "key").agg(F.min(F.struct("ord", "seq", "canonical")).alias("first"))
    later = keyed.join(owner, ["composer", "key"]).filter(
        F.struct("ord", "seq") != F.struct(F.col("first.ord"), F.col("first.seq"))
    )
    same = F.col("canonical") == F.col("first.canonical")
    unknown = nearest_composers(dictionary).withColumn("label", work_label())
    return [
        _issue(works.filter(_blank("canonical")), "error", "work", F.col("label"), "name_empty"),
        _issue(works.filter(_blank("composer")), "error", "work", F.col("label"), "composer_empty"),
        _issue(
            unknown, "error", "work", F.col("label"), "composer_unknown",
            F.concat_ws(" @", "closest", F.col("differs_at").cast("string")),
        ),
        _issue(repeated, "error", "work", F.col("label"), "work_repeated"),
        _issue(names.filter("key = ''"), "warning", "work", F.col("label"), "alias_empty", F.col("name")),
        _issue(
            later, F.when(same, "warning").otherwise("error"), "work", F.col("label"),
            F.when(same, "alias_repeated").otherwise("alias_used"),
            F.when(same, F.col("name")).otherwise(F.concat_ws(" <- ", "name", "first.canonical")),
        ),
    ]


def invalid_patterns(dictionary: Dictionary) -> DataFrame:
    """Typo rows whose pattern the regex engine refuses. The patterns are tried in
    the driver because the same list is folded into the rule there."""
    spark = dictionary.typos.sparkSession
    rows = dictionary.typos.select("ord", "pattern").filter(~_blank("pattern")).collect()
    bad = [(r["ord"],) for r in rows if not is_valid_pattern(spark, r["pattern"])]
    return dictionary.typos.join(spark.createDataFrame(bad, "ord long"), "ord", "left_semi")


def validate(dictionary: Dictionary) -> DataFrame:
    """Issues as (severity, category, target, code, detail)."""
    persons = dictionary.persons.filter(~_blank("canonical"))
    roles = persons.select("canonical", F.explode("roles").alias("role")).filter(~F.lower("role").isin(ROLES))
    typos = dictionary.typos
    bad = invalid_patterns(dictionary)
    fine = typos.filter(~_blank("pattern")).join(bad.select("ord"), "ord", "left_anti")
    protected = dictionary.protected.withColumn("key", name_key(F.col("value")))
    first = protected.groupBy("key").agg(F.min("ord").alias("first"))
    overrides = dictionary.overrides
    placed = overrides.filter(~_blank("folder"))
    no_effect = ~F.coalesce("exclude", F.lit(False)) & _blank("work_name") & _blank("composer") & _blank("date")
    parts = [
        _issue(dictionary.composers.filter(_blank("canonical")), "error", "composer", BLANK, "name_empty"),
        _issue(dictionary.persons.filter(_blank("canonical")), "error", "person", BLANK, "name_empty"),
        _issue(persons.filter(F.size("roles") == 0), "warning", "person", F.col("canonical"), "no_role"),
        _issue(roles, "error", "person", F.col("canonical"), "role_unknown", F.col("role")),
        *_ensemble_issues(dictionary.ensembles),
        _issue(typos.filter(_blank("pattern")), "error", "typo", BLANK, "pattern_empty"),
        _issue(bad, "error", "typo", F.col("pattern"), "pattern_invalid"),
        _issue(
            fine.filter(F.coalesce("replacement", F.lit("")) == ""), "warning", "typo", F.col("pattern"), "replacement_empty"
        ),
        _issue(protected.filter("key = ''"), "error", "protected", BLANK, "value_empty"),
        _issue(
            protected.filter("key <> ''").join(first, "key").filter("ord <> first"), "warning", "protected",
            F.col("value"), "value_repeated",
        ),
        *_work_issues(dictionary),
        _issue(overrides.filter(_blank("folder")), "error", "override", BLANK, "folder_empty"),
        _issue(placed.filter(no_effect), "warning", "override", F.col("folder"), "no_effect"),
        _issue(
            placed.filter(~_blank("date") & ~F.col("date").rlike(r"^\d{4}$")), "error", "override", F.col("folder"),
            "year_form", F.col("date"),
        ),
        _issue(placed.filter(_blank("note")), "warning", "override", F.col("folder"), "note_empty"),
        *_name_issues(_owned_names(dictionary)),
    ]
    return reduce(DataFrame.unionByName, parts)


# ---- merge (W11, W12, W21) ----------------------------------------------------------------------


def _entry_names(dictionary: Dictionary) -> DataFrame:
    """(category, ord, id key, target, label, seq, name, key) of every entry."""
    def part(table: DataFrame, category: str, names: Column, ident: Column, target: str, label: Column) -> DataFrame:
        return table.select(
            F.lit(category).alias("category"), "ord", ident.alias("entry"), F.col(target).alias("target"),
            label.alias("label"), F.posexplode(names).alias("seq", "name"),
        ).withColumn("key", name_key(F.col("name")))

    aliases = F.concat("aliases", "aliases_ja")
    named = F.filter(
        F.concat(F.array("canonical"), F.transform("eras", lambda e: e["canonical"])), lambda n: F.trim(n) != ""
    )
    simple = [
        part(t, c, F.concat(F.array("canonical"), aliases), name_key(F.col("canonical")), "canonical", F.col("canonical"))
        for c, t in (("composer", dictionary.composers), ("person", dictionary.persons))
    ]
    ensembles = part(
        dictionary.ensembles, "ensemble", F.concat(named, aliases), F.lower("entity_id"), "entity_id", ensemble_label()
    )
    return reduce(DataFrame.unionByName, [*simple, ensembles])


def _entries(dictionary: Dictionary) -> DataFrame:
    """(category, ord, entry, target) of every entry, named or not."""
    simple = [
        t.select(F.lit(c).alias("category"), "ord", name_key(F.col("canonical")).alias("entry"), F.col("canonical").alias("target"))
        for c, t in (("composer", dictionary.composers), ("person", dictionary.persons))
    ]
    ensembles = dictionary.ensembles.select(
        F.lit("ensemble").alias("category"), "ord", F.lower("entity_id").alias("entry"), F.col("entity_id").alias("target")
    )
    return reduce(DataFrame.unionByName, [*simple, ensembles])


_ITEM = ["kind", "category", "target", "detail", "item_ord"]


def merge_plan(user: Dictionary, bundled: Dictionary) -> DataFrame:
    """What the bundled dictionary has and the user's has not."""
    heads = _entries(user).groupBy("category", "entry").agg(
        F.min("ord").alias("ord"), F.min_by("target", "ord").alias("mine")
    )
    held = _entry_names(user).join(heads.select("category", "entry", "ord"), ["category", "entry", "ord"])
    added = _entries(bundled).join(heads, ["category", "entry"], "left_anti").select(
        F.concat(F.lit("add_"), "category").alias("kind"), "category", "target", F.lit("").alias("detail"),
        F.struct("ord", F.lit(-1).alias("seq")).alias("item_ord"),
    )
    known = _entry_names(bundled).join(heads.select("category", "entry", "mine"), ["category", "entry"])
    aliases = (
        known.join(held.select("category", "entry", "key").distinct(), ["category", "entry", "key"], "left_anti")
        .select(
            F.lit("add_alias").alias("kind"), "category", F.col("mine").alias("target"), F.col("name").alias("detail"),
            F.struct("ord", "seq").alias("item_ord"),
        )
    )
    first_ens = user.ensembles.groupBy(F.lower("entity_id").alias("id")).agg(
        F.min_by(F.struct("no_conductor", "no_era_split"), "ord").alias("f")
    )
    flags = bundled.ensembles.join(first_ens, F.lower("entity_id") == F.col("id"))

    def flag(kind: str, column: str) -> DataFrame:
        return flags.filter(F.col(column) & ~F.col(f"f.{column}")).select(
            F.lit(kind).alias("kind"), F.lit("ensemble").alias("category"), F.col("entity_id").alias("target"),
            F.lit("").alias("detail"), F.struct("ord", F.lit(-1).alias("seq")).alias("item_ord"),
        )

    typos = bundled.typos.join(user.typos.select("pattern"), "pattern", "left_anti").select(
        F.lit("add_typo").alias("kind"), F.lit("typo").alias("category"), F.col("pattern").alias("target"),
        F.coalesce("replacement", F.lit("")).alias("detail"), F.struct("ord", F.lit(-1).alias("seq")).alias("item_ord"),
    )
    key = name_key(F.col("value")).alias("key")
    protected = (
        bundled.protected.select("ord", "value", key).join(user.protected.select(key), "key", "left_anti").select(
            F.lit("add_protected").alias("kind"), F.lit("protected").alias("category"), F.col("value").alias("target"),
            F.lit("").alias("detail"), F.struct("ord", F.lit(-1).alias("seq")).alias("item_ord"),
        )
    )
    return reduce(
        DataFrame.unionByName,
        [added, aliases, flag("enable_no_conductor", "no_conductor"), flag("enable_no_era_split", "no_era_split"),
         typos, protected],
    ).select(*_ITEM)


def needs_update(user: Dictionary, bundled: Dictionary) -> bool:
    """W21."""
    return not merge_plan(user, bundled).isEmpty()


def _after(table: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows behind the last one; the shift is a scalar subquery, not a collect."""
    shift = table.agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).alias("shift")).scalar()
    return table.unionByName(new.withColumn("ord", F.col("ord") + shift).select(*table.columns))


def _append_aliases(table: DataFrame, ident: Column, items: DataFrame) -> DataFrame:
    """Append alias items (entry, detail, item_ord) to the first row of each entry."""
    grouped = items.groupBy("entry").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("item_ord", "detail"))), lambda x: x["detail"]).alias("new")
    )
    keyed = table.withColumn("_entry", ident)
    first = keyed.groupBy("_entry").agg(F.min("ord").alias("_first"))
    joined = keyed.join(first, "_entry").join(grouped, F.col("_entry") == F.col("entry"), "left")
    new = F.when(F.col("ord") == F.col("_first"), F.coalesce("new", X.no_texts())).otherwise(X.no_texts())
    return joined.withColumns(
        {
            "aliases": F.concat("aliases", F.filter(new, lambda a: ~X.is_japanese(a))),
            "aliases_ja": F.concat("aliases_ja", F.filter(new, X.is_japanese)),
        }
    ).select(*table.columns)


def merge_apply(user: Dictionary, bundled: Dictionary, items: DataFrame) -> Dictionary:
    """Apply the chosen items; the version becomes the bundled one."""
    def of(kind: str, category: str | None = None) -> DataFrame:
        out = items.filter(F.col("kind") == kind)
        return out if category is None else out.filter(F.col("category") == category)

    def aliases(category: str, ident: Column) -> DataFrame:
        return of("add_alias", category).select(ident.alias("entry"), "detail", "item_ord")

    by_name, by_id = name_key(F.col("canonical")), F.lower("entity_id")
    target_key = name_key(F.col("target"))
    made = {}
    for category, table in (("composer", "composers"), ("person", "persons")):
        mine, theirs = getattr(user, table), getattr(bundled, table)
        wanted = of(f"add_{category}").select(target_key.alias("_t"))
        new = theirs.withColumn("_k", by_name).join(wanted, F.col("_k") == F.col("_t"), "left_semi").drop("_k")
        made[table] = _after(_append_aliases(mine, by_name, aliases(category, target_key)), new)
    flags = (
        items.filter(F.col("kind").startswith("enable_"))
        .groupBy(F.lower("target").alias("_f"))
        .agg(
            F.bool_or(F.col("kind") == "enable_no_conductor").alias("_nc"),
            F.bool_or(F.col("kind") == "enable_no_era_split").alias("_ns"),
        )
    )
    mine = _append_aliases(user.ensembles, by_id, aliases("ensemble", F.lower("target")))
    flagged = mine.join(flags, by_id == F.col("_f"), "left").withColumns(
        {
            "no_conductor": F.col("no_conductor") | F.coalesce("_nc", F.lit(False)),
            "no_era_split": F.col("no_era_split") | F.coalesce("_ns", F.lit(False)),
        }
    ).select(*mine.columns)
    wanted = of("add_ensemble").select(F.lower("target").alias("_t"))
    new = bundled.ensembles.join(wanted, by_id == F.col("_t"), "left_semi")
    made["ensembles"] = _after(flagged, new)
    made["typos"] = _after(
        user.typos, bundled.typos.join(of("add_typo").select(F.col("target").alias("pattern")), "pattern", "left_semi")
    )
    made["protected"] = _after(
        user.protected, of("add_protected").select(F.col("item_ord.ord").alias("ord"), F.col("target").alias("value"))
    )
    return user.with_tables(version=bundled.version, **made)


# ---- redundant aliases (W13) ----------------------------------------------------------------------


def _alias_names(dictionary: Dictionary) -> DataFrame:
    names = dict_names(dictionary)
    works = (
        dictionary.works.withColumn("label", work_label())
        .select(
            F.lit("work").alias("category"), "ord",
            F.posexplode(
                F.concat(
                    F.array(F.struct(F.lit("canonical").alias("source"), F.col("canonical").alias("name"))),
                    F.transform("aliases", lambda a: F.struct(F.lit("alias").alias("source"), a.alias("name"))),
                    F.transform("aliases_ja", lambda a: F.struct(F.lit("alias_ja").alias("source"), a.alias("name"))),
                )
            ).alias("seq", "n"),
            F.col("label").alias("canonical"),
        )
        .select("category", "ord", "seq", "canonical", "n.source", "n.name", name_key(F.col("n.name")).alias("key"))
    )
    return names.unionByName(works)


def redundant_aliases(dictionary: Dictionary) -> DataFrame:
    """Aliases whose key an earlier name of the same entry has. A one-word
    composer alias stays when the name it would fall back on has a space, because
    one-word aliases mark surnames."""
    names = _alias_names(dictionary)
    holder = names.filter("key <> ''").groupBy("category", "ord", "key").agg(
        F.min(F.struct("seq", "name")).alias("kept")
    )
    later = names.filter(F.col("source").isin("alias", "alias_ja")).join(holder, ["category", "ord", "key"])
    later = later.filter(F.col("seq") > F.col("kept.seq"))
    guarded = (
        (F.col("category") == "composer") & (F.col("source") == "alias")
        & ~F.contains("name", F.lit(" ")) & F.contains(F.col("kept.name"), F.lit(" "))
    )
    return later.filter(~guarded).select(
        "category", "ord", "seq", F.col("canonical").alias("owner"), "source", "name", F.col("kept.name").alias("kept_name")
    )


def clean_aliases(dictionary: Dictionary, only: str | None = None) -> Dictionary:
    """W13 applied: the tables without their redundant aliases."""
    removed = redundant_aliases(dictionary)
    made = {}
    for category, table in (("composer", "composers"), ("person", "persons"), ("ensemble", "ensembles"), ("work", "works")):
        if only not in (None, category):
            continue
        source = getattr(dictionary, table)
        offset = F.lit(1) + (F.size("eras") if category == "ensemble" else F.lit(0))
        drop = removed.filter(F.col("category") == category).groupBy("ord").agg(F.collect_set("seq").alias("_drop"))
        joined = source.join(drop, "ord", "left")
        gone = F.coalesce("_drop", F.array().cast("array<int>"))
        made[table] = joined.withColumns(
            {
                "aliases_ja": F.filter(
                    "aliases_ja", lambda a, i: ~F.array_contains(gone, i + offset + F.size("aliases"))
                ),
                "aliases": F.filter("aliases", lambda a, i: ~F.array_contains(gone, i + offset)),
            }
        ).select(*source.columns)
    return dictionary.with_tables(**made)


# ---- bulk edits (W18) -----------------------------------------------------------------------------


def _fresh(values: Column, taken: Column) -> Column:
    """Trimmed values whose key is neither taken nor given before; empty keys pass."""
    keyed = F.transform(
        F.filter(F.transform(values, X.strip), lambda a: a != ""),
        lambda a: F.struct(a.alias("v"), name_key(a).alias("k")),
    )
    fresh = F.filter(keyed, lambda p: (p["k"] == "") | ~F.array_contains(taken, p["k"]))
    return let(
        fresh,
        lambda ps: F.transform(
            F.filter(
                ps,
                lambda p, i: (p["k"] == "")
                | (F.array_position(F.transform(ps, lambda q: q["k"]), p["k"]) == i + 1),
            ),
            lambda p: p["v"],
        ),
    )


def _split_script(values: Column) -> tuple[Column, Column]:
    return F.filter(values, lambda a: ~X.is_japanese(a)), F.filter(values, X.is_japanese)


def new_entries(rows: DataFrame) -> DataFrame:
    """Rows (canonical, aliases, ..) with the aliases split by script, without the
    canonical itself and repeats."""
    fresh = _fresh(F.col("aliases"), F.array(name_key(F.col("canonical"))))
    latin, japanese = _split_script(F.col("_fresh"))
    return rows.withColumn("_fresh", fresh).withColumns({"aliases_ja": japanese, "aliases": latin}).drop("_fresh")


def add_entries(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Append new composers, persons or ensembles (``ord`` gives their order)."""
    return _after(table, new_entries(rows))


def add_aliases(table: DataFrame, rows: DataFrame, names: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Append aliases (target, alias, seq) to entries; returns (table, rejected rows).

    A target is a canonical name (or an era name of an ensemble). An alias whose
    key the entry already has is left out."""
    names = F.array("canonical") if names is None else names
    owners = table.select("ord", F.explode(names).alias("target")).filter("target is not null")
    first = owners.groupBy("target").agg(F.min("ord").alias("_ord"))
    matched = rows.join(first, "target", "left")
    added = matched.filter("_ord is not null").groupBy("_ord").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "alias"))), lambda x: x["alias"]).alias("_new")
    )
    taken = name_keys(F.concat(names, "aliases", "aliases_ja"))
    joined = table.join(added, F.col("ord") == F.col("_ord"), "left").withColumn(
        "_fresh", _fresh(F.coalesce("_new", X.no_texts()), taken)
    )
    latin, japanese = _split_script(F.col("_fresh"))
    out = joined.withColumns(
        {"aliases": F.concat("aliases", latin), "aliases_ja": F.concat("aliases_ja", japanese)}
    ).select(*table.columns)
    return out, matched.filter("_ord is null").select(*rows.columns)


def upsert_works(works: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (ord, composer, canonical, aliases): a known (composer, canonical) only
    gains aliases, others are appended once."""
    trimmed = rows.withColumns({"composer": X.strip(F.col("composer")), "canonical": X.strip(F.col("canonical"))})
    grouped = trimmed.groupBy("composer", "canonical").agg(
        F.min("ord").alias("_ord"),
        F.flatten(
            F.transform(F.array_sort(F.collect_list(F.struct("ord", "aliases"))), lambda x: x["aliases"])
        ).alias("_new"),
    )
    first = works.groupBy("composer", "canonical").agg(F.min("ord").alias("ord"))
    known = grouped.join(first, ["composer", "canonical"]).select("ord", "_new")
    taken = name_keys(F.concat(F.array("canonical"), "aliases", "aliases_ja"))
    joined = works.join(known, "ord", "left").withColumn("_fresh", _fresh(F.coalesce("_new", X.no_texts()), taken))
    latin, japanese = _split_script(F.col("_fresh"))
    grown = joined.withColumns(
        {"aliases": F.concat("aliases", latin), "aliases_ja": F.concat("aliases_ja", japanese)}
    ).select(*works.columns)
    new = grouped.join(first, ["composer", "canonical"], "left_anti").select(
        F.col("_ord").alias("ord"), "composer", "canonical", F.col("_new").alias("aliases")
    )
    return _after(grown, new_entries(new))


def upsert_overrides(overrides: DataFrame, rows: DataFrame) -> DataFrame:
    """The latest row per (folder, disc) replaces the first existing one in its
    place; others are appended."""
    fields = ["folder", "disc", "composer", "work_name", "date", "exclude", "note"]
    keyed_rows = rows.withColumn("_key", folder_lookup_key(F.col("folder")))
    latest = keyed_rows.groupBy("_key", "disc").agg(
        F.max_by(F.struct(*fields), "ord").alias("_row"), F.min("ord").alias("_new_ord")
    )
    keyed = overrides.withColumn("_key", folder_lookup_key(F.col("folder")))
    first = keyed.groupBy("_key", "disc").agg(F.min("ord").alias("_first"))
    same = [F.col("k._key") == F.col("n._key"), F.col("k.disc").eqNullSafe(F.col("n.disc"))]
    placed = latest.alias("n").join(first.alias("k"), same, "left").select("n._row", "n._new_ord", "k._first")
    replaced = overrides.join(placed.filter("_first is not null"), F.col("ord") == F.col("_first"), "left").select(
        "ord", *[F.when(F.col("_first").isNotNull(), F.col(f"_row.{f}")).otherwise(F.col(f)).alias(f) for f in fields]
    )
    new = placed.filter("_first is null").select(F.col("_new_ord").alias("ord"), "_row.*")
    return _after(replaced, new)


_SUFFIX = r"^(.+)-([1-9]\d{0,8})$"


def entity_ids(names: DataFrame, ensembles: DataFrame) -> DataFrame:
    """F15 for new ensembles (ord, canonical): slugs, with the next free suffix, as
    if given one after another in the order of ``ord``.

    The r-th name of a stem gets its r-th free number. A number is not free if an old
    id has it, or if the slug of another name is that very id ("Foo 2") and came
    earlier; whether it did when its turn came follows from the stem's own names
    alone. A stem whose parent ("foo" of "foo-2") gave its plain id away loses its
    first number. So stems are decided by the number of suffixes in them, in as many
    steps as the longest slug has; places are counted over ranges, so a stem may have
    any number of names. Only where slugs are ids of other stems does one task see
    the numbers (not the names) of a stem together."""
    slug = X.slug(F.col("canonical"))
    depth = F.size(F.regexp_extract_all(F.regexp_extract(slug, r"((?:-\d+)+)$", 1), F.lit(r"-\d+"), F.lit(0)))
    waiting = names.select("ord", "canonical", slug.alias("stem"), depth.alias("depth"))
    waiting = settle(numbered_within(waiting, "r", "stem", "ord"), "stems")
    first = waiting.filter("r = 0").select("stem", F.col("ord").alias("e"))
    claims = _numbers(first, "stem", "e").filter("n > 1")
    old = ensembles.select(F.lower("entity_id").alias("id")).filter("id is not null").distinct()
    taken = old.select(F.col("id").alias("stem"), F.lit(1).alias("n")).unionByName(_numbers(old, "id").filter("n > 1"))
    given: list[DataFrame] = []
    deepest = waiting.agg(F.max("depth")).head()[0]
    for level in range(0 if deepest is None else deepest + 1):
        here = waiting.filter(F.col("depth") == level)
        stems = here.select("stem").distinct()
        blocked = taken.join(stems, "stem", "left_semi")
        if given:
            lost = given[-1].select(F.col("entity_id").alias("stem"), F.col("ord").alias("by")).join(first, "stem").filter("by < e")
            blocked = blocked.unionByName(lost.select("stem", F.lit(1).alias("n"))).distinct()
        open_claims = claims.join(stems, "stem", "left_semi").join(blocked, ["stem", "n"], "left_anti")
        skipped = _skipped(here, open_claims, blocked)
        given.append(settle(_with_free_numbers(here, blocked.unionByName(skipped)), "ids"))
    if not given:
        return names.select("ord", "canonical", F.lit("").alias("entity_id")).limit(0)
    return reduce(DataFrame.unionByName, given)


def _numbers(ids: DataFrame, column: str, *keep: str) -> DataFrame:
    """(stem, n) of ids that are a stem and a number."""
    number = F.regexp_extract(column, _SUFFIX, 2).try_cast("int")
    return ids.select(F.regexp_extract(column, _SUFFIX, 1).alias("stem"), number.alias("n"), *keep).filter("n is not null")


def _skipped(names: DataFrame, claims: DataFrame, blocked: DataFrame) -> DataFrame:
    """Claims (stem, n, e) that were made before the stem's names come to the number."""
    rows = (
        claims.select("stem", F.lit(2).alias("kind"), F.col("n").cast("long").alias("a"), F.col("e").cast("long").alias("b"))
        .unionByName(blocked.select("stem", F.lit(0).alias("kind"), F.col("n").cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
        .unionByName(names.select("stem", F.lit(1).alias("kind"), F.col("r").cast("long").alias("a"), F.col("ord").cast("long").alias("b")))
    )

    def of_stem(table: pa.Table) -> pa.Table:
        kind, a, b = (table[c].to_numpy() for c in ("kind", "a", "b"))
        before = np.sort(a[kind == 0])
        came = b[kind == 1][np.argsort(a[kind == 1])]
        order = np.argsort(a[kind == 2])
        out: list[int] = []
        for n, e in zip(a[kind == 2][order].tolist(), b[kind == 2][order].tolist()):
            place = n - int(np.searchsorted(before, n)) - len(out)  # which name would get the number
            if place > len(came):
                break
            if e < came[place - 1]:
                out.append(n)
        return pa.table({"stem": pa.array([table["stem"][0].as_py()] * len(out), pa.string()), "n": pa.array(out, pa.int32())})

    claimed = rows.join(claims.select("stem").distinct(), "stem", "left_semi")
    return claimed.groupBy("stem").applyInArrow(of_stem, "stem string, n int")


def _with_free_numbers(names: DataFrame, blocked: DataFrame) -> DataFrame:
    """The r-th name of a stem with its r-th number that is not blocked.

    Before the j-th blocked number b stand b - j free ones, so among names (by r) and
    blocked numbers (by b - j, first at a tie) a name's place is its number."""
    plain = names.join(blocked.select("stem").distinct(), "stem", "left_anti").withColumn("n", F.col("r") + 1)
    held = numbered_within(blocked, "j", "stem", "n").select("stem", (F.col("n") - F.col("j") - 1).alias("k"), F.lit(False).alias("is_name"))
    asked = names.join(blocked.select("stem").distinct(), "stem", "left_semi").withColumns({"k": F.col("r"), "is_name": F.lit(True)})
    mixed = numbered_within(asked.unionByName(held, allowMissingColumns=True), "at", "stem", "k", "is_name")
    counted = mixed.filter("is_name").withColumn("n", F.col("at") + 1).select(*names.columns, "n")
    entity_id = F.when(F.col("n") == 1, F.col("stem")).otherwise(F.concat_ws("-", "stem", F.col("n").cast("string")))
    return plain.unionByName(counted).select("ord", "canonical", entity_id.alias("entity_id"))


# ---- import, trial, registration (W19, W20, W24, W25) ------------------------------------------------


def import_works(dictionary: Dictionary, works: DataFrame, overrides: DataFrame) -> tuple[Dictionary, DataFrame]:
    """Cleaned works and overrides replace the old ones. Returns the result and
    its issues; the caller writes it only when no issue is an error."""
    merged = clean_aliases(dictionary.with_tables(works=works, overrides=overrides), only="work")
    return merged, validate(merged)


def has_error(issues: DataFrame) -> bool:
    return not issues.filter("severity = 'error'").isEmpty()


def try_typo(texts: DataFrame, column: str, pattern: str, replacement: str) -> DataFrame:
    """Texts that one pattern changes."""
    fixed = X.fix_typos(F.col(column), [(pattern, replacement)])
    return texts.filter(F.col(column).rlike(pattern)).select(F.col(column).alias("before"), fixed.alias("after"))


def register_unknown(unknown: DataFrame, decisions: DataFrame, lookup: DataFrame) -> DataFrame:
    """Decisions (value, category, action alias|new, target, canonical, entity_id,
    roles) with the unknown values they are for; ``problem`` is null for rows to take
    over. Every decision stays."""
    found = unknown.select("value", "category", "n_paths", F.lit(True).alias("_found"))
    df = decisions.join(found, ["value", "category"], "left")
    df = df.select("value", "category", "n_paths", *[c for c in df.columns if c not in ("value", "category", "n_paths")])
    target, name = _blank("target"), _blank("canonical")
    problem = (
        F.when(F.col("_found").isNull(), "not_found")
        .when((F.col("action") == "alias") & target, "no_target")
        .when((F.col("action") == "new") & name, "no_name")
        .when((F.col("action") == "new") & (F.col("category") == "ensemble") & _blank("entity_id"), "no_entity_id")
        .when((F.col("action") == "new") & (F.col("category") == "person") & (F.coalesce(F.size("roles"), F.lit(0)) <= 0), "no_role")
        .when(~F.coalesce(F.col("action").isin("alias", "new"), F.lit(False)), "no_action")
    )
    return already_known(df.withColumn("problem", problem).drop("_found"), "value", lookup)


def take_over(dictionary: Dictionary, checked: DataFrame) -> tuple[Dictionary, DataFrame]:
    """The dictionary with the accepted decisions, and what became of each
    (seq, value, category, action, code); ``code`` is null where it was taken.

    Rows are taken in the order of ``seq``. An alias goes to the first entry with the
    target as a name; a name that the entry has, or that an earlier row gave it, is not
    given again. A new entry is made once, by the first row that names it."""
    rows = checked.select("seq", "value", "category", "action", "target", "canonical", "entity_id", "roles", "problem")
    fine = rows.filter("problem is null")
    ensembles = dictionary.ensembles
    named = {
        "composer": (dictionary.composers, F.array("canonical")), "person": (dictionary.persons, F.array("canonical")),
        "ensemble": (ensembles, F.concat(F.array("canonical"), F.transform("eras", lambda e: e["canonical"]))),
    }
    owners = reduce(DataFrame.unionByName, [
        t.select(F.lit(c).alias("category"), "ord", F.explode(names).alias("target")) for c, (t, names) in named.items()
    ]).filter("target is not null").groupBy("category", "target").agg(F.min("ord").alias("ord"))
    held = _entry_names(dictionary).select("category", "ord", "key", F.lit(True).alias("held")).distinct()
    aliases = (
        fine.filter("action = 'alias'").withColumn("key", name_key(F.col("value")))
        .join(owners, ["category", "target"], "left").join(held, ["category", "ord", "key"], "left")
    )
    earliest = aliases.filter("ord is not null").groupBy("category", "ord", "key").agg(F.min("seq").alias("first"))
    aliases = aliases.join(earliest, ["category", "ord", "key"], "left").withColumn(
        "code",
        F.when(F.col("ord").isNull(), "unknown_target").when(F.col("held"), "already_there")
        .when(F.col("seq") > F.col("first"), "claimed"),
    )
    entry = F.when(F.col("category") == "ensemble", F.lower(X.strip(F.col("entity_id")))).otherwise(name_key(F.col("canonical")))
    made = fine.filter("action = 'new'").withColumn("entry", entry)
    known = _entries(dictionary).select("category", "entry", F.lit(True).alias("known")).distinct()
    earliest = made.groupBy("category", "entry").agg(F.min("seq").alias("first"))
    made = made.join(known, ["category", "entry"], "left").join(earliest, ["category", "entry"]).withColumn(
        "code", F.when(F.col("known"), "exists").when(F.col("seq") > F.col("first"), "claimed")
    )
    keep = ["seq", "value", "category", "action"]
    outcome = reduce(DataFrame.unionByName, [
        rows.filter("problem is not null").select(*keep, F.col("problem").alias("code")),
        aliases.select(*keep, "code"), made.select(*keep, "code"),
    ])
    tables = {}
    for category, (table, names) in named.items():
        given = aliases.filter((F.col("category") == category) & F.col("code").isNull())
        grown, _ = add_aliases(table, given.select("target", F.col("value").alias("alias"), "seq"), names)
        new = made.filter((F.col("category") == category) & F.col("code").isNull()).select(
            F.col("seq").cast("long").alias("ord"), X.strip(F.col("canonical")).alias("canonical"), F.array("value").alias("aliases"),
            "roles", X.strip(F.col("entity_id")).alias("entity_id"), F.lit(False).alias("no_era_split"), F.lit(False).alias("no_conductor"),
            F.array().cast(ensembles.schema["eras"].dataType).alias("eras"),
        )
        tables[f"{category}s"] = add_entries(grown, new)
    return dictionary.with_tables(**tables), outcome


def register_works(units: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (folder, disc, composer, name, aliases) for units (albums as a
    list). ``problem``: no such unit, or no name; warned when album and folder numbers
    disagree (U4). Every decision stays."""
    held = units.select(
        F.col("folder").alias("_folder"), F.col("disc").alias("_disc"), F.coalesce("albums", X.no_texts()).alias("albums"), F.lit(True).alias("_found")
    )
    df = decisions.join(held, (F.col("folder") == F.col("_folder")) & F.col("disc").eqNullSafe(F.col("_disc")), "left")
    album = F.array_distinct(F.flatten(F.transform("albums", X.numbers_in)))
    folder = X.numbers_in(F.element_at(F.split("folder", "/"), -1))
    apart = (F.size(album) > 0) & (F.size(folder) > 0) & (F.size(F.array_intersect(album, folder)) == 0)
    return df.select(
        *decisions.columns,
        F.when(F.col("_found").isNull(), "no_unit").when(_blank("name"), "no_name").alias("problem"),
        F.when(apart, "numbers_disagree").alias("warning"),
    )


def take_over_works(dictionary: Dictionary, checked: DataFrame) -> Dictionary:
    """The works of the accepted decisions (``seq`` is their order)."""
    rows = checked.filter("problem is null").select(F.col("seq").cast("long").alias("ord"), "composer", F.col("name").alias("canonical"), "aliases")
    return dictionary.with_tables(works=upsert_works(dictionary.works, rows))


def check_overrides(rows: DataFrame, holds: DataFrame, units: DataFrame | None = None, composers: DataFrame | None = None) -> DataFrame:
    """Override proposals (folder, disc, composer, work_name, date, exclude, note)
    against the holds (folder, disc, unit_hold); ``problem`` is null for acceptable rows.

    One row per proposal. Without a disc it is for the whole folder, where excluding
    is offered unless all its held units wait for a date only. An excluding row keeps
    no other choice. With ``units`` (folder, disc, composers, dates), a date must be one
    of the unit's own, and a composer one of the unit's or of ``composers`` (name)."""
    of_date = F.bool_and(F.coalesce(F.col("unit_hold") == "DateUnknown", F.lit(False))).alias("_of_date")
    by_disc = holds.filter("disc is not null").groupBy("folder", "disc").agg(of_date)
    none = F.lit(None).cast(holds.schema["disc"].dataType)
    by_folder = holds.groupBy("folder").agg(of_date).withColumn("disc", none)
    held = by_disc.unionByName(by_folder).withColumnsRenamed({"folder": "_folder", "disc": "_disc"})
    at = (F.col("folder") == F.col("_folder")) & F.col("disc").eqNullSafe(F.col("_disc"))
    df = rows.join(held, at, "left").drop("_folder", "_disc")
    excludes = F.coalesce("exclude", F.lit(False))
    choices = ["composer", "work_name", "date"]
    problem = (
        F.when(F.col("_of_date").isNull(), "not_held")
        .when(_blank("note"), "no_note")
        .when(~excludes & _blank("composer") & _blank("work_name") & _blank("date"), "no_effect")
        .when(excludes & F.col("_of_date"), "exclude_not_offered")
        .when(~excludes & ~_blank("date") & ~F.col("date").rlike(r"^\d{4}$"), "year_form")
    )
    if units is not None:
        for choice in ("composer", "date"):
            own = units.select("folder", "disc", F.explode(f"{choice}s").alias("_value"))
            own = own.unionByName(own.withColumn("disc", none)).distinct().withColumnsRenamed({"folder": "_folder", "disc": "_disc"})
            own = own.withColumn(f"_own_{choice}", F.lit(True))
            df = df.join(own, at & (F.col(choice) == F.col("_value")), "left").drop("_folder", "_disc", "_value")
        if composers is not None:
            listed = composers.select(F.col("name").alias("_name"), F.lit(True).alias("_listed")).distinct()
            df = df.join(listed, F.col("composer") == F.col("_name"), "left").drop("_name")
        else:
            df = df.withColumn("_listed", F.lit(None).cast("boolean"))
        problem = problem.when(~excludes & ~_blank("date") & F.col("_own_date").isNull(), "date_not_in_unit").when(
            ~excludes & ~_blank("composer") & F.coalesce("_own_composer", "_listed").isNull(), "composer_not_offered"
        )
    kept = [F.when(~excludes, F.col(c)).alias(c) if c in choices else F.col(c) for c in rows.columns]
    return df.select(*kept, problem.alias("problem"))
