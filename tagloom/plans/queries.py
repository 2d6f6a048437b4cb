"""The registered queries: every one reads its whole tables or what is derived from them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.functions import text as X
from tagloom.functions.keys import name_key
from tagloom.operators import apply as A, dictionary_jobs as D, findings as G, reports as R, suggest as S
from tagloom.operators.lineage import settle
from tagloom.operators.lookup import build_lookup
from tagloom.operators.ordering import numbered
from tagloom.operators.rules import REGISTRY
from tagloom.operators.units import album_units
from tagloom.plans import oracle as O
from tagloom.plans.audit import inspect
from tagloom.plans.fixture import (
    derived_dictionary, fixture_decisions, fixture_edits, fixture_files, fixture_index, fixture_snapshot, fixture_tracks,
    fixture_versions,
)
from tagloom.schema import FIELDS
from tagloom.sources import catalogue as C, export as E
from tagloom.sources.dictionary import describe

Query = Callable[[SparkSession, str], DataFrame]

# Optional rules too: a named run is the whole registry.
ALL_RULES = [r.id for r in REGISTRY]


def flat(changes: DataFrame) -> DataFrame:
    return changes.select(
        "relative_path", "field", texts("before").alias("before"), texts("after").alias("after"),
        "rule_id", "severity", "hold", F.col("evidence")["code"].alias("code"),
    )


def texts(column: str):
    return F.array_join(column, "; ")


def rule_query(rule_id: str) -> Query:
    return lambda spark, sf: flat(inspect(fixture_tracks(spark, sf), fixture_index(spark), rules=[rule_id]))


def rule_name(rule_id: str) -> str:
    return "rule_" + rule_id.replace("-", "").lower()


def audit(spark, sf, rules) -> DataFrame:
    return inspect(fixture_tracks(spark, sf), fixture_index(spark), rules=rules)


def pending(spark, sf) -> DataFrame:
    return A.edits_to_changes(A.manual_edits(fixture_tracks(spark, sf), fixture_edits(spark, sf)))


def proposals(spark, sf) -> DataFrame:
    return audit(spark, sf, ALL_RULES).unionByName(pending(spark, sf))


def q_unknown(spark, sf):
    return G.unknown_values(audit(spark, sf, ["R-201", "R-202"]))


def q_top(spark, sf):
    return G.top_findings(audit(spark, sf, ALL_RULES))


def q_units(spark, sf):
    units = album_units(C.with_derived(fixture_tracks(spark, sf)), fixture_index(spark))
    return units.select("folder", "disc", "n_tracks", *[texts(c).alias(c) for c in ("composers", "artists", "dates", "albums")])


def report_units(spark, sf):
    return R.report_units(fixture_tracks(spark, sf), fixture_index(spark))


def q_plan(spark, sf):
    return A.apply_plan(proposals(spark, sf)).select("relative_path", "field", texts("new_values").alias("new_values"))


def q_conflicts(spark, sf):
    return A.apply_conflicts(proposals(spark, sf)).select("relative_path", "field", "proposals", "resolved", "adopted")


def q_overlay(spark, sf):
    plan = A.apply_plan(proposals(spark, sf))
    out = A.overlay(fixture_tracks(spark, sf), plan)
    return out.select("relative_path", *[texts(f).alias(f) for f in FIELDS])


def q_verify(spark, sf):
    """Verification against rows that were not written: every planned field differs."""
    plan = A.apply_plan(audit(spark, sf, ALL_RULES))
    return A.verify(plan, fixture_tracks(spark, sf)).select(
        "relative_path", "field", texts("expected").alias("expected"), texts("actual").alias("actual")
    )


def q_remaining(spark, sf):
    """Findings left after an apply: only fields with differing proposals keep theirs."""
    changes = settle(proposals(spark, sf), "proposals")
    conflicts = A.apply_conflicts(changes)
    done = A.succeeded_fields(changes, conflicts.filter(F.lit(False)), conflicts)
    return G.remove_findings(changes, done).groupBy("rule_id").agg(F.count("*").alias("n"))


def q_selection(spark, sf):
    changes = audit(spark, sf, ALL_RULES)
    scope = C.in_scope(F.lower(X.folder_of(F.col("relative_path"))), "Brahms")
    inverted = G.set_selection(changes, scope, None)
    return inverted.groupBy("rule_id").agg(F.count("*").alias("found"), F.count_if("is_selected").alias("selected"))


def q_restore_items(spark, sf):
    tracks = fixture_tracks(spark, sf)
    return A.restore_items(fixture_snapshot(tracks), tracks).select(
        "relative_path", "field", texts("current_values").alias("current"), texts("new_values").alias("snapshot")
    )


def q_restore_missing(spark, sf):
    tracks = fixture_tracks(spark, sf)
    return A.restore_missing(tracks, fixture_snapshot(tracks))


def q_restore_added(spark, sf):
    tracks = fixture_tracks(spark, sf)
    return A.restore_added(fixture_snapshot(tracks), tracks)


def q_edits(spark, sf):
    return pending(spark, sf).select(
        "relative_path", "field", texts("before").alias("before"), texts("after").alias("after"), "clears",
        F.col("evidence")["code"].alias("code"),
    )


def q_edit_warnings(spark, sf):
    return A.edit_warnings(pending(spark, sf), fixture_tracks(spark, sf), fixture_index(spark))


def q_change_export(spark, sf):
    return E.change_rows(audit(spark, sf, ALL_RULES))


def q_track_export(spark, sf):
    tracks = fixture_tracks(spark, sf)
    return E.track_rows(tracks, A.manual_edits(tracks, fixture_edits(spark, sf)))


def q_summary_export(spark, sf):
    return E.summary_rows(audit(spark, sf, ALL_RULES))


def q_filters(spark, sf):
    """Scope, missing-field and text filters, counted together."""
    tracks = C.with_derived(fixture_tracks(spark, sf))
    return tracks.select(
        C.in_scope(F.col("folder_key"), "Brahms").alias("in_scope"), C.has_empty_field().alias("has_empty"),
        C.contains_text("karajan").alias("has_text"),
    ).groupBy("in_scope", "has_empty", "has_text").agg(F.count("*").alias("n"))


def q_scan(spark, sf):
    """Raw tag rows of three formats, made from the catalogue, go through the scan again."""
    tracks = fixture_tracks(spark, sf)
    k = F.regexp_extract("relative_path", r"/(\d{12}) [^/]*$", 1).cast("long")
    fmt = F.when(k % 7 == 0, "M4a").when(k % 7 == 1, "Id3").otherwise("Flac")

    def raw_tags(name: str):
        """Values with a blank one behind; in M4a, track numbers are pairs of bytes."""
        entries = []
        for f, tag in C.RAW_NAMES[name].items():
            values = F.when(F.size(f) > 0, F.concat(F.col(f), F.array(F.lit(" ")))).otherwise(F.col(f))
            if name == "M4a" and f == "tracknumber":
                part = lambda v, i: F.lpad(F.hex(F.split_part(v, F.lit("/"), F.lit(i)).cast("long")), 4, "0")
                values = F.transform(f, lambda v: F.concat(F.lit("0x0000"), part(v, 1), part(v, 2), F.lit("0000")))
            entries.append(F.struct(F.lit(tag).alias("k"), values.alias("v")))
        return F.map_from_entries(F.array(*entries))

    extension = F.when(fmt == "M4a", ".m4a").when(fmt == "Id3", ".MP3").otherwise(".flac")
    path = F.concat(F.regexp_replace("relative_path", r"\.flac$", ""), extension)
    raw = tracks.select(
        F.when(path.startswith("Dvorak"), F.concat(F.lit("Backup_1/"), path)).otherwise(path).alias("relative_path"), "full_path",
        F.when(fmt == "M4a", raw_tags("M4a")).when(fmt == "Id3", raw_tags("Id3")).otherwise(raw_tags("Flac")).alias("raw_tags"),
        F.when(F.contains("relative_path", F.lit("Track04")), F.lit("cannot read")).alias("error"),
    )
    good, failed = C.scan(raw)
    keep = ["relative_path", "format"]
    return good.select(*keep, *[texts(f).alias(f) for f in FIELDS], F.lit(None).cast("string").alias("message")).unionByName(
        failed.select("relative_path", "message"), allowMissingColumns=True
    )


def q_natural(spark, sf):
    """The place of every path in natural order."""
    tracks = fixture_tracks(spark, sf).select("relative_path")
    return numbered(tracks.withColumn("key", X.natural_key(F.col("relative_path"))), "place", "key").select("relative_path", "place")


def cannot_write():
    """The rows of a write that fail, as a locked file would."""
    return F.when(F.col("relative_path").endswith("Track04.flac"), "cannot write")


def folder():
    return X.folder_of(F.col("relative_path")).alias("folder")


def q_applied(spark, sf):
    """Counters of an apply per folder, from the version it wrote; some rows fail."""
    done = A.apply_changes(
        fixture_tracks(spark, sf), proposals(spark, sf), fixture_versions(spark), fixture_versions(spark), error=cannot_write()
    )
    return A.counters_of(done.outcomes, folder())


def q_restored(spark, sf):
    """Counters of a restore per folder, from the version it wrote; some rows fail."""
    tracks = fixture_tracks(spark, sf)
    done = A.restore_version(fixture_snapshot(tracks), tracks, fixture_versions(spark), error=cannot_write())
    return A.counters_of(done.outcomes, folder())


def q_verify_partly(spark, sf):
    """Verification of a version to which a third of the planned rows was not written."""
    tracks, plan = fixture_tracks(spark, sf), settle(A.apply_plan(audit(spark, sf, ALL_RULES)), "plan")
    k = F.regexp_extract("relative_path", r"/(\d{12}) [^/]*$", 1).cast("long")
    return A.verify(plan, A.overlay(tracks, plan.filter(k % 3 != 0))).select(
        "relative_path", "field", texts("expected").alias("expected"), texts("actual").alias("actual")
    )


def q_listing(spark, sf):
    """The audio files of a folder, names of every kind among them."""
    return C.list_files(spark, fixture_files(spark, sf)).select("relative_path", "format")


def q_entity_ids(spark, sf):
    """Ids for new ensembles, a third of them of one name."""
    names = spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "CAST(p_partkey AS LONG) AS ord",
        "CASE WHEN p_partkey % 3 = 0 THEN '!!' ELSE 'Group: ' || substr('abcdefghijklmnopqrstuvwxyz', CAST(p_partkey % 26 AS INT) + 1, 1) END AS canonical",
    )
    old = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr(
        """CASE WHEN s_suppkey = 1 THEN 'Ensemble' WHEN s_suppkey % 2 = 0 THEN 'ensemble-' || (s_suppkey * 7)
           ELSE 'group-' || substr('abcdefghijklmnopqrstuvwxyz', CAST(s_suppkey % 26 AS INT) + 1, 1) || '-' || (s_suppkey % 10) END AS entity_id"""
    )
    return D.entity_ids(names, old)


def registration(spark, sf):
    dictionary = derived_dictionary(spark, sf)
    unknown, decisions = fixture_decisions(spark, sf)
    return D.take_over(dictionary, D.register_unknown(unknown, decisions, build_lookup(dictionary)))


def q_registered(spark, sf):
    """What became of each decision on an unknown value."""
    return registration(spark, sf)[1]


def q_registered_entries(spark, sf):
    """Composers and persons after the decisions were taken over."""
    made = registration(spark, sf)[0]
    parts = [t.select(F.lit(c).alias("category"), "canonical", texts("aliases").alias("aliases")) for c, t in (("composer", made.composers), ("person", made.persons))]
    return parts[0].unionByName(parts[1])


def q_registered_works(spark, sf):
    """Checks of a work name for every unit, for folders that are none, and without a disc."""
    units = album_units(C.with_derived(fixture_tracks(spark, sf)), fixture_index(spark)).select("folder", "disc", "n_tracks", "albums")
    asked = units.select("folder", "disc", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("v"), "n_tracks")
    decisions = asked.selectExpr(
        "IF(v = 1, folder || '!', folder) AS folder", "IF(v = 2, NULL, disc) AS disc", "'C' AS composer",
        "IF(n_tracks % 5 = 0, ' ', 'Work ' || (n_tracks % 7)) AS name", "array('x') AS aliases",
    )
    return D.register_works(units, decisions).select("folder", "disc", "name", "problem", "warning")


def q_override_checks(spark, sf):
    """Override proposals for every unit against its own values."""
    units = album_units(C.with_derived(fixture_tracks(spark, sf)), fixture_index(spark)).select("folder", "disc", "n_tracks", "composers", "dates")
    holds = units.selectExpr("folder", "disc", "IF(n_tracks % 4 = 0, 'DateUnknown', 'WorkUnknown') AS unit_hold").filter("disc < 3")
    rows = units.selectExpr(
        "folder", "disc", "CASE n_tracks % 3 WHEN 0 THEN get(composers, 0) WHEN 1 THEN 'Nobody' END AS composer", "CAST(NULL AS STRING) AS work_name",
        "CASE n_tracks % 5 WHEN 0 THEN get(dates, 0) WHEN 1 THEN '1804' WHEN 2 THEN '75' END AS date", "n_tracks % 7 = 0 AS exclude",
        "IF(n_tracks % 11 = 0, '', 'note') AS note",
    )
    names = D.canonicals(derived_dictionary(spark, sf)).filter("category = 'composer'")
    return D.check_overrides(rows, holds, units, names).select("folder", "disc", "composer", "date", "exclude", "problem")


def q_keys(spark, sf):
    """Normalisation keys of every name in the catalogue."""
    values = fixture_tracks(spark, sf).select(F.explode(F.concat("artist", "albumartist", "composer", "conductor", "album", "title")).alias("value"))
    return values.groupBy("value").agg(F.count("*").alias("n")).withColumn("key", name_key(F.col("value")))


def q_issues(spark, sf):
    return D.validate(derived_dictionary(spark, sf))


def q_merge(spark, sf):
    plan = D.merge_plan(derived_dictionary(spark, sf, bundled=False), derived_dictionary(spark, sf))
    return plan.select("kind", "category", "target", "detail")


def q_merged(spark, sf):
    """Entries per list after all items are taken over."""
    user, bundled = derived_dictionary(spark, sf, bundled=False), derived_dictionary(spark, sf)
    return describe(D.merge_apply(user, bundled, D.merge_plan(user, bundled)))


def q_redundant(spark, sf):
    return D.redundant_aliases(derived_dictionary(spark, sf)).select("category", "owner", "source", "name", "kept_name")


def q_canonicals(spark, sf):
    return D.canonicals(derived_dictionary(spark, sf))


def q_known(spark, sf):
    """Which customer and supplier names the derived dictionary already has."""
    lookup = build_lookup(derived_dictionary(spark, sf, bundled=False))
    names = derived_dictionary(spark, sf).composers.select(F.explode(F.concat(F.array("canonical"), "aliases")).alias("value")).distinct()
    return D.already_known(names, "value", lookup)


def q_suggest_names(spark, sf):
    """Suggestions for every distinct alias, its first seven characters and six from inside it."""
    alias = derived_dictionary(spark, sf, bundled=False).composers.select(F.explode("aliases").alias("a"))
    asked = alias.select(F.explode(F.array("a", F.substring("a", 1, 7), F.substring("a", 4, 6))).alias("query"))
    return S.suggest_names(asked, derived_dictionary(spark, sf), "composer")


def q_suggest_works(spark, sf):
    units = album_units(C.with_derived(fixture_tracks(spark, sf)), fixture_index(spark)).persist()
    single = units.filter(F.size("composers") == 1).select("folder", "disc", F.get("composers", F.lit(0)).alias("composer"), "albums")
    return S.suggest_works(single, fixture_index(spark))


def q_hints(spark, sf):
    folders = C.with_derived(fixture_tracks(spark, sf)).select("folder")
    return S.folder_hints(folders, fixture_index(spark)).select("folder", "hint")


def q_template(spark, sf):
    made = S.works_template(report_units(spark, sf).persist(), fixture_index(spark))
    tagged = {
        "works": made["works"].select("composer", texts("aliases").alias("aliases"), texts("aliases_ja").alias("aliases_ja"), "first_alias"),
        "members": made["members"].withColumn("label", F.to_json("label")),
    }
    parts = [df.select(F.lit(name).alias("table"), "*") for name, df in (made | tagged).items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def q_typo_trial(spark, sf):
    titles = fixture_tracks(spark, sf).select(F.explode("title").alias("title"))
    return D.try_typo(titles, "title", r"\bAllgro\b", "Allegro").groupBy("before", "after").agg(F.count("*").alias("n"))


def q_known_units(spark, sf):
    """Album-name decision per unit."""
    from tagloom.operators.units import decide_album_names

    return decide_album_names(C.with_derived(fixture_tracks(spark, sf)), fixture_index(spark)).select(
        "folder", "disc", "unit_hold", "unit_album", "unit_code"
    )


OTHER: dict[str, Query] = {
    "rule_summary": lambda s, d: G.rule_summary(audit(s, d, ALL_RULES)),
    "unknown_values": q_unknown,
    "top_findings": q_top,
    "selection": q_selection,
    "album_units": q_units,
    "album_names": q_known_units,
    "folder_tree": lambda s, d: R.folder_tree(fixture_tracks(s, d)),
    "library_stats": lambda s, d: R.library_stats(fixture_tracks(s, d)),
    "format_counts": lambda s, d: R.format_counts(fixture_tracks(s, d)),
    "inventory": lambda s, d: R.inventory(report_units(s, d)),
    "multi_disc_folders": lambda s, d: R.multi_disc_folders(report_units(s, d)),
    "coherence": lambda s, d: R.coherence(report_units(s, d)),
    "collision_candidates": lambda s, d: R.collision_candidates(report_units(s, d)),
    "merged_groups": lambda s, d: R.merged_groups(report_units(s, d)),
    "performer_collisions": lambda s, d: R.ensembles_with_artists(report_units(s, d)),
    "performer_dates": lambda s, d: R.artists_with_dates(report_units(s, d)),
    "apply_plan": q_plan,
    "apply_conflicts": q_conflicts,
    "apply_overlay": q_overlay,
    "verify": q_verify,
    "remaining_findings": q_remaining,
    "restore_plan": q_restore_items,
    "restore_missing": q_restore_missing,
    "restore_added": q_restore_added,
    "manual_edits": q_edits,
    "edit_warnings": q_edit_warnings,
    "change_export": q_change_export,
    "summary_export": q_summary_export,
    "track_export": q_track_export,
    "row_filters": q_filters,
    "scan": q_scan,
    "natural_sort_key": q_natural,
    "name_keys": q_keys,
    "typo_trial": q_typo_trial,
    "listing": q_listing,
    "apply_counters": q_applied,
    "restore_applied": q_restored,
    "verify_partly": q_verify_partly,
    "entity_ids": q_entity_ids,
    "register_names": q_registered,
    "registered_entries": q_registered_entries,
    "register_works": q_registered_works,
    "override_checks": q_override_checks,
    "dict_issues": q_issues,
    "dict_merge_plan": q_merge,
    "dict_merge_apply": q_merged,
    "redundant_aliases": q_redundant,
    "canonical_names": q_canonicals,
    "already_known": q_known,
    "suggest_names": q_suggest_names,
    "alias_hints": q_hints,
    "suggest_works": q_suggest_works,
    "works_template": q_template,
}

QUERIES: dict[str, Query] = {rule_name(r.id): rule_query(r.id) for r in REGISTRY} | OTHER
ORACLES: dict[str, str] = {rule_name(r): O.with_prelude(sql) for r, sql in O.RULE_SQL.items()} | O.other_sql(ALL_RULES)
