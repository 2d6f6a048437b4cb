"""Suggestions in bulk (W14-W17) and the audit report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tagloom.functions import text as X
from tagloom.functions.keys import decode_mojibake, has_japanese_run, maybe_mojibake, name_key, name_key_of, name_keys
from tagloom.operators import reports
from tagloom.operators.lineage import cut, settle
from tagloom.operators.lookup import DICTIONARY_TOKEN, WHOLE, Index
from tagloom.plans.audit import AuditContext, inspect
from tagloom.sources.dictionary import Dictionary

TOP_NAMES = 20
TOP_WORKS = 8
TOP_TEMPLATES = 3
SAME_COMPOSER, TEMPLATE = "same composer", "template"


# ---- names (W14) -----------------------------------------------------------------------------


def name_candidates(dictionary: Dictionary, category: str) -> DataFrame:
    """(canonical, pos, name, key): every entry's names; each ensemble name is an entry."""
    if category == "ensemble":
        named = F.filter(
            F.concat(F.array("canonical"), F.transform("eras", lambda e: e["canonical"])), lambda n: F.trim(n) != ""
        )
        entries = dictionary.ensembles.select("ord", F.posexplode(named).alias("sub", "canonical"), "aliases", "aliases_ja")
    else:
        table = dictionary.composers if category == "composer" else dictionary.persons
        entries = table.select("ord", F.lit(0).alias("sub"), "canonical", "aliases", "aliases_ja")
    entries = entries.withColumn("canonical", F.trim("canonical")).filter("canonical <> ''")
    first = entries.groupBy("canonical").agg(F.min_by(F.struct("aliases", "aliases_ja"), F.struct("ord", "sub")).alias("e"))
    names = F.array_distinct(
        F.filter(F.concat(F.array("canonical"), F.col("e.aliases"), F.col("e.aliases_ja")), lambda n: ~X.is_blank(n))
    )
    return first.select("canonical", F.posexplode(names).alias("pos", "name")).withColumn(
        "key", name_key(F.col("name"))
    )


def suggest_names(queries: DataFrame, dictionary: Dictionary, category: str, limit: int = TOP_NAMES) -> DataFrame:
    """For each distinct ``query``, entries with a name that contains it.

    A name that contains the query contains each three characters of it. Names are
    found by an equi-join on the rarest of these pieces and then tested; no query meets
    every name, and a start that all names share is not what they are found by."""
    names = name_candidates(dictionary, category)
    asked = queries.select("query").distinct().withColumn("q", name_key(F.col("query")))

    def pieces(text: str, n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))

    every = F.array_distinct(F.concat(*[pieces("key", n) for n in (1, 2, 3)]))
    index = names.filter("key <> ''").select("*", F.explode(every).alias("piece"))
    own = F.when(F.length("q") > 3, F.array_distinct(pieces("q", 3))).otherwise(F.array("q"))
    probe = asked.filter("q <> ''").select("query", "q", F.explode(own).alias("piece"))
    # a piece that no name has counts 0: then there is nothing to join
    uses = index.groupBy("piece").agg(F.count("*").alias("uses"))
    rarest = probe.join(uses, "piece", "left").groupBy("query", "q").agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "piece")).alias("p"))
    rarest = rarest.filter("p.uses > 0").select("query", "q", F.col("p.piece").alias("piece"))
    hits = rarest.join(index, "piece").filter(F.contains("key", F.col("q")))
    alias = F.col("name") != F.col("canonical")
    rank = F.when(F.startswith(F.col("key"), F.col("q")), 0).otherwise(2) + alias.cast("int")
    best = (
        hits.withColumn("rank", rank)
        .groupBy("query", "canonical")
        .agg(F.min(F.struct("rank", "pos", "name")).alias("b"))
        .select(
            "query", "canonical", F.col("b.rank").alias("rank"),
            F.when(F.col("b.name") != F.col("canonical"), F.col("b.name")).alias("matched_alias"),
        )
    )
    order = Window.partitionBy("query").orderBy("rank", "canonical")
    ranked = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    # An empty query lists the first entries by name: the same short list for each.
    first = names.select("canonical").distinct().orderBy("canonical").limit(limit)
    listed = first.withColumn("place", F.row_number().over(Window.orderBy("canonical")))
    blank = asked.filter("q = ''").select("query", F.lit("").alias("q")).join(listed.withColumn("q", F.lit("")), "q").select(
        "query", "canonical", F.lit(0).alias("rank"), F.lit(None).cast("string").alias("matched_alias"), "place"
    )
    return ranked.unionByName(blank)


# ---- folder hints (W16) -------------------------------------------------------------------------


def folder_hints(folders: DataFrame, index: Index, first_only: bool = False) -> DataFrame:
    """(folder, pos, hint): path segments that are no composer, and their heads.

    With ``first_only``, only the first such segment counts."""
    parts = F.transform(X.segments(F.col("folder")), lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    rows = folders.select("folder").distinct().select("folder", F.explode(parts).alias("p"))
    rows = rows.select("folder", F.col("p.i").alias("i"), F.col("p.s").alias("segment"))
    rows = index.resolve(rows, name_key_of("segment"), "w", "composer").filter("w_composer is null")
    if first_only:
        rows = rows.groupBy("folder").agg(F.min(F.struct("i", "segment")).alias("m")).select("folder", "m.*")
    both = rows.select(
        "folder", "i",
        F.posexplode(F.array(F.col("segment"), X.head_of(F.col("segment")))).alias("j", "hint"),
    ).filter("hint is not null")
    both = index.resolve(both, name_key_of("hint"), "h", "composer").filter("j = 0 or h_composer is null")
    usable = both.withColumn("key", name_key_of("hint")).filter("key <> ''")
    return usable.groupBy("folder", "hint", "key").agg((F.min(F.struct("i", "j"))).alias("pos"))


# ---- work names (W15, F17) ------------------------------------------------------------------------


def strip_composers(hints: DataFrame, index: Index, row_id: list[str]) -> DataFrame:
    """``cleaned`` = the hint without composer names."""
    words = F.filter(F.split("hint", f"[{X.WORD_SEPARATORS}:]+"), lambda w: w != "")
    parts = hints.select(*row_id, F.posexplode(words).alias("p", "word"))
    parts = parts.withColumn("bare", F.nullif(X.trim_name(F.col("word")), F.lit("")))
    bare = {"bare": (F.array_compact(F.array("bare")), WHOLE + DICTIONARY_TOKEN)}
    parts = index.with_facts(parts, bare, "contained").filter("bare_contained is null")
    cleaned = parts.groupBy(*row_id).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "word"))), lambda x: x["word"]), " ").alias("t")
    )
    text = X.loosen_number(X.trim_name(F.col("t")))
    return hints.join(cleaned.withColumn("cleaned", text).drop("t"), row_id, "left")


def suggest_works(units: DataFrame, index: Index) -> DataFrame:
    """W15 for units (folder, disc, composer, albums): up to eight names per unit:
    cleaned hints, works of the composer, then templates filled with the numbers."""
    unit = ["folder", "disc"]
    from_albums = units.select(*unit, "composer", F.posexplode("albums").alias("i", "hint")).select(
        *unit, "composer", F.struct(F.lit(0).alias("a"), F.col("i").alias("b"), F.lit(0).alias("c")).alias("pos"), "hint"
    )
    hints = folder_hints(units, index)
    from_folder = units.select(*unit, "composer").join(hints, "folder").select(
        *unit, "composer", F.struct(F.lit(1).alias("a"), F.col("pos.i").alias("b"), F.col("pos.j").alias("c")).alias("pos"), "hint"
    )
    # Each part that several others are made of is written once, or every one of them would make it again.
    hint = settle(from_albums.unionByName(from_folder), "hints")
    latin = hint.filter(~X.has_japanese(F.col("hint")))
    row_id = [*unit, "pos"]
    cleaned = settle(
        strip_composers(latin, index, row_id).filter((F.length("cleaned") >= 2) & F.col("cleaned").rlike(r"\p{L}")), "cleaned"
    )
    text = {"cleaned": (F.array("cleaned"), WHOLE + DICTIONARY_TOKEN)}
    cleaned = index.with_facts(cleaned, text, "contained").filter("cleaned_contained is null")
    own = cleaned.select(*unit, F.col("cleaned").alias("value"), F.lit("hint").alias("source"),
                         F.lit(0).alias("step"), F.col("pos.a").alias("x"), F.col("pos.b").alias("y"),
                         F.col("pos.c").alias("z"), F.lit("").alias("t"))

    # All numbers and words of a unit's hints. Both sets come from a folder name and
    # its few album names. A unit without hints has none of either, but stays.
    every = units.select(*unit, "composer", F.lit(None).cast(hint.schema["pos"].dataType).alias("pos"), F.lit(None).cast("string").alias("hint"))
    has_hint = F.col("hint").isNotNull()
    facts = hint.unionByName(every).groupBy(*unit, "composer").agg(
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.when(has_hint, F.struct("pos", X.numbers_in(F.col("hint")).alias("ns"))))), lambda x: x["ns"]
            )
        ).alias("n"),
        F.array_distinct(
            F.flatten(F.collect_list(F.when(has_hint, name_keys(X.tokens(F.col("hint"), X.WORD_SEPARATORS)))))
        ).alias("words"),
    ).withColumn("numbers", F.array_distinct("n"))
    facts = settle(facts, "numbers")
    works = index.dictionary.works.filter("trim(canonical) <> ''")
    same = facts.join(works.select(F.col("composer"), "canonical"), "composer").filter(
        (F.size("numbers") == 0) | (F.size(F.array_intersect("numbers", X.numbers_in(F.col("canonical")))) > 0)
    )
    same = same.select(*unit, F.col("canonical").alias("value"), F.lit(SAME_COMPOSER).alias("source"),
                       F.lit(1).alias("step"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"),
                       F.col("canonical").alias("t"))
    # Templates with their counts; matching ones are found by word, the most
    # frequent ones serve every unit, so no unit meets every template.
    templates = (
        works.select(X.work_template(F.col("canonical")).alias("template")).filter("template is not null")
        .groupBy("template").agg(F.count("*").alias("uses"))
    )
    words = templates.select(
        "template", "uses", F.explode(F.array_distinct(name_keys(X.tokens(F.col("template"), X.WORD_SEPARATORS)))).alias("word")
    ).filter("word <> ''")
    numbered = facts.filter(F.size("numbers") > 0)
    matching = (
        numbered.select(*unit, "numbers", F.explode("words").alias("word"))
        .join(words, "word").select(*unit, "numbers", "template", "uses").distinct().withColumn("match", F.lit(0))
    )
    common = templates.orderBy(F.desc("uses"), "template").limit(TOP_TEMPLATES).withColumn("one", F.lit(1))
    general = numbered.withColumn("one", F.lit(1)).join(common, "one").select(
        *unit, "numbers", "template", "uses", F.lit(1).alias("match")
    )
    offered = matching.unionByName(general).groupBy(*unit, "template").agg(
        F.min("match").alias("match"), F.max("uses").alias("uses"), F.first("numbers").alias("numbers")
    )
    filled = offered.select(*unit, "template", "match", "uses", F.posexplode("numbers").alias("k", "number"))
    rank = Window.partitionBy(*unit).orderBy("match", F.desc("uses"), "template", "k")
    made = filled.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= TOP_TEMPLATES).select(
        *unit, F.replace("template", F.lit("{0}"), F.col("number")).alias("value"), F.lit(TEMPLATE).alias("source"),
        F.lit(2).alias("step"), F.col("r").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"), F.lit("").alias("t"),
    )
    union = reduce(DataFrame.unionByName, [own, same, made]).withColumn("key", name_key(F.col("value")))
    order = F.struct("step", "x", "y", "z", "t")
    once = union.groupBy(*unit, "key").agg(F.min(F.struct(order.alias("o"), "value", "source")).alias("m"))
    place = F.row_number().over(Window.partitionBy(*unit).orderBy("m.o"))
    return once.withColumn("place", place).filter(F.col("place") <= TOP_WORKS).select(
        *unit, "place", F.col("m.value").alias("value"), F.col("m.source").alias("source")
    )


# ---- works template (W17) ---------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (item, key) pairs: the smallest key reachable from
    each key. Each round spreads labels over items and then follows labels of
    labels, so long chains close in few rounds."""
    edges = cut(edges.select("item", "key").distinct())
    labels = cut(edges.select("key").distinct().withColumn("label", F.col("key")))
    while True:
        per_item = edges.join(labels, "key").groupBy("item").agg(F.min("label").alias("label"))
        spread = edges.join(per_item, "item").groupBy("key").agg(F.min("label").alias("label"))
        jump = spread.select(F.col("key").alias("label"), F.col("label").alias("further"))
        new = spread.join(jump, "label", "left").select("key", F.least("label", F.coalesce("further", "label")).alias("label"))
        new = cut(new)
        changed = new.join(labels.withColumnRenamed("label", "old"), "key").filter("label <> old")
        if changed.isEmpty():
            return new
        labels = new


def _without_mojibake(albums: DataFrame) -> DataFrame:
    suspect = albums.filter(maybe_mojibake(F.col("album"))).select("album").distinct()
    broken = suspect.filter(has_japanese_run(decode_mojibake(F.col("album"))))
    return albums.join(broken, "album", "left_anti")


def works_template(units: DataFrame, index: Index) -> dict[str, DataFrame]:
    """W17 from units (folder, disc, n_tracks, composers, albums): groups of units of
    one composer that share a folder hint, their alias candidates, and what was left out."""
    single = units.filter(F.size("composers") == 1).withColumn("composer", F.get("composers", F.lit(0)))
    hints = folder_hints(single, index, first_only=True)
    linked = single.select("folder", "disc", "composer").join(hints, "folder")
    # Each part that several others are made of is written once, or every one of them would make it again.
    scoped = settle(linked.select(
        F.struct("folder", "disc").alias("item"), F.struct("composer", "key").alias("key"), "composer", "folder",
        "disc", "hint", "pos", F.col("key").alias("hint_key"),
    ), "hints")
    labels = components(scoped.select("item", "key"))
    member = settle(scoped.join(labels, "key"), "members")
    unit_group = member.select("folder", "disc", "composer", "label").distinct()
    group_keys = member.select("composer", "label", "hint_key").distinct()
    preferred = member.groupBy("folder", "disc", "composer", "label").agg(F.max(F.struct("pos", "hint", "hint_key")).alias("p"))
    aliases = preferred.select("composer", "label", F.col("p.hint").alias("alias"), F.col("p.hint_key").alias("key"), "folder")
    named = _without_mojibake(single.select("folder", "disc", F.explode("albums").alias("album")))
    claims = settle(
        named.join(unit_group, ["folder", "disc"]).withColumn("key", name_key(F.col("album"))).filter("key <> ''")
        .groupBy("composer", "label", "key", "album").agg(F.min("folder").alias("folder")), "claims"
    )
    owners = claims.select("composer", "key", "label").distinct().groupBy("composer", "key").agg(F.count("*").alias("owners"))
    open_claims = claims.join(
        group_keys.withColumnRenamed("hint_key", "key"), ["composer", "label", "key"], "left_anti"
    ).join(owners, ["composer", "key"])
    ambiguous = open_claims.filter("owners > 1").select("composer", "album", "owners").distinct()
    promoted = open_claims.filter("owners = 1").select("composer", "label", F.col("album").alias("alias"), "key", "folder")
    alias = settle(aliases.unionByName(promoted).groupBy("composer", "label", "key").agg(
        F.min("alias").alias("alias"), F.min("folder").alias("folder")
    ), "aliases")
    works = alias.groupBy("composer", "label").agg(F.array_sort(F.collect_set("alias")).alias("names")).select(
        "composer",
        F.filter("names", lambda n: ~X.has_japanese(n)).alias("aliases"),
        F.filter("names", X.has_japanese).alias("aliases_ja"),
        F.get("names", F.lit(0)).alias("first_alias"),
    )
    unresolved = units.join(unit_group.select("folder", "disc"), ["folder", "disc"], "left_anti").select(
        "folder", "disc", "n_tracks", reports.joined("composers").alias("composer")
    )
    foreign = AuditContext.other_composers(index, alias.select("composer", "alias", "folder"))
    return {"works": works, "ambiguous": ambiguous, "foreign": foreign, "unresolved": unresolved, "members": unit_group}


def audit_report(tracks: DataFrame, index: Index) -> dict[str, DataFrame]:
    """Every report in one run, from one set of units."""
    # Units are far fewer than tracks and serve every report; losing an executor only
    # recomputes its part.
    units = reports.report_units(tracks, index).persist()
    made = {
        "inventory": reports.inventory(units),
        "multi_disc_folders": reports.multi_disc_folders(units),
        "coherence": reports.coherence(units),
        "several_composers": reports.split_units(units, "composers"),
        "several_dates": reports.split_units(units, "dates"),
        "several_artists": reports.split_units(units, "artists"),
        "no_date": reports.dateless_units(units),
        "collision_candidates": reports.collision_candidates(units),
        "merged_groups": reports.merged_groups(units),
        "ensembles_with_artists": reports.ensembles_with_artists(units),
        "artists_with_dates": reports.artists_with_dates(units),
        "composer_mismatch": inspect(tracks, index, rules=["R-210"]),
    }
    return made | {f"template_{k}": v for k, v in works_template(units, index).items()}
