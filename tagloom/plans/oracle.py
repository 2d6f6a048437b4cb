"""The registered queries again as plain SQL for another engine.

Written independently of the Spark plans: values are resolved by joins and
windows over the same derived catalogue and the same dictionary rows."""

from __future__ import annotations

from tagloom.plans import fixture as fx


def K(x: str) -> str:
    return f"regexp_replace(strip_accents(lower({x})), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')"


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    return "'" + v.replace("'", "''") + "'"


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(_lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def _name_rows() -> list[tuple]:
    rows = []
    for i, (c, a, j) in enumerate(fx.COMPOSERS):
        rows += [("composer", i, s, c, n, k) for s, (n, k) in enumerate([(c, "canonical")] + [(x, "alias") for x in a] + [(x, "alias_ja") for x in j])]
    for i, (c, _, a, j) in enumerate(fx.PERSONS):
        rows += [("person", i, s, c, n, k) for s, (n, k) in enumerate([(c, "canonical")] + [(x, "alias") for x in a] + [(x, "alias_ja") for x in j])]
    for i, (e, c, eras, _, _, a, j) in enumerate(fx.ENSEMBLES):
        names = [(x[2], "era") for x in eras] + ([(c, "canonical")] if c else []) + [(x, "alias") for x in a] + [(x, "alias_ja") for x in j]
        rows += [("ensemble", i, s, e, n, k) for s, (n, k) in enumerate(names)]
    return rows


DICT_SEP = r"'[ \t,;:/\-()\[\]&.　、・]+'"
FIND_SEP = r"'[ \t,;:/\-_()\[\]&.　、・]+'"
JP = "[ぁ-ゖァ-ヿ一-鿿]"


def _ngrams(source: str, column: str) -> str:
    """Rows (column, len, start, gram) of the token runs, and the whole text as length 9."""
    return f"""
  SELECT {column} AS v, 9 AS len, 0 AS start, {K(column)} AS gram FROM {source}
  UNION ALL
  SELECT v, len, start, {K("array_to_string(list_slice(tk, start, start + len - 1), ' ')")} AS gram FROM (
    SELECT v, tk, len, unnest(range(1, len(tk) - len + 2)) AS start FROM (
      SELECT {column} AS v, list_filter(regexp_split_to_array({column}, {FIND_SEP}), lambda x: x <> '') AS tk, unnest([1, 2, 3]) AS len FROM {source}))
"""


WORK_ROWS = [(i, c, w, s, n) for i, (c, w, a, j) in enumerate(fx.WORKS) for s, n in enumerate([w] + a + j)]
OVERRIDE_ROWS = [(i, *row) for i, row in enumerate(fx.OVERRIDES)]

PRELUDE = f"""
WITH fx AS ({fx.SCALARS}),
t AS (
  SELECT *, lower(folder) AS folder_key,
    CASE WHEN composer IS NULL AND composer2 IS NULL THEN [] WHEN composer2 IS NULL THEN [composer] WHEN composer IS NULL THEN [composer2] ELSE [composer, composer2] END AS composer_l,
    CASE WHEN composer IS NULL THEN composer2 WHEN composer2 IS NULL THEN composer ELSE composer || '; ' || composer2 END AS composer_t,
    regexp_extract(relative_path, '([^/]*)$', 1) AS file,
    regexp_replace(regexp_extract(relative_path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem,
    CASE WHEN try_cast(trim(split_part(discnumber, '/', 1)) AS INT) > 0 THEN CAST(trim(split_part(discnumber, '/', 1)) AS INT) ELSE 1 END AS disc,
    try_cast(nullif(regexp_extract(date, '(1[0-9]{{3}}|20[0-9]{{2}})', 1), '') AS INT) AS yr
  FROM fx),
{_values("names0", "category, ord, seq, owner, name, source", _name_rows())},
names AS (SELECT *, {K("name")} AS key FROM names0),
{_values("persons", "person, conductor", [(c, "Conductor" in r) for c, r, _, _ in fx.PERSONS])},
{_values("ensembles", "ens_id, ens_canonical, has_eras, no_split, no_conductor", [(e, c, bool(eras), ns, nc) for e, c, eras, ns, nc, _, _ in fx.ENSEMBLES])},
{_values("eras", "ens_id, o, from_y, until_y, name", [(e, i, a, b, n) for e, _, eras, *_ in fx.ENSEMBLES for i, (a, b, n) in enumerate(eras)])},
{_values("works0", "ord, composer, work, seq, name", WORK_ROWS)},
works AS (SELECT composer, {K("name")} AS key, min_by(work, ord * 1000 + seq) AS work FROM works0 GROUP BY 1, 2),
{_values("overrides", "ord, folder, disc, composer, work_name, date, exclude, note", OVERRIDE_ROWS)},
{_values("protected0", "value", [(p,) for p in fx.PROTECTED])},
protected AS (SELECT {K("value")} AS key FROM protected0),
lc AS (SELECT key, min_by(owner, ord * 1000 + seq) AS composer FROM names WHERE category = 'composer' AND key <> '' GROUP BY 1),
lp AS (SELECT n.key, n.person, p.conductor FROM (SELECT key, min_by(owner, ord * 1000 + seq) AS person FROM names WHERE category = 'person' AND key <> '' GROUP BY 1) n JOIN persons p USING (person)),
le AS (SELECT n.key, e.* FROM (SELECT key, min_by(owner, ord * 1000 + seq) AS ens_id FROM names WHERE category = 'ensemble' AND key <> '' GROUP BY 1) n JOIN ensembles e USING (ens_id)),
surnames AS (
  SELECT DISTINCT {K("regexp_extract(name, '([^ ]+)$', 1)")} AS key FROM names WHERE category = 'composer' AND source = 'canonical'
  UNION SELECT key FROM names WHERE category = 'composer' AND source = 'alias' AND NOT contains(name, ' ')),
occ AS (
  SELECT track_id, 'artist' AS field, 1 AS field_ord, artist AS v FROM t WHERE artist IS NOT NULL
  UNION ALL SELECT track_id, 'albumartist', 2, albumartist FROM t
  UNION ALL SELECT track_id, 'conductor', 4, conductor FROM t WHERE conductor IS NOT NULL
  UNION ALL SELECT track_id, 'composer', 3, composer_l[1] FROM t WHERE len(composer_l) = 1),
vals AS (SELECT DISTINCT v, {K("v")} AS key FROM (SELECT v FROM occ UNION SELECT unnest(composer_l) FROM t)),
toks AS (SELECT v, i, {K("tok")} AS key FROM (SELECT v, unnest(l) AS tok, generate_subscripts(l, 1) AS i FROM (SELECT v, regexp_split_to_array(v, {DICT_SEP}) AS l FROM vals))),
tokhit AS (SELECT v, min_by(lc.composer, i) AS composer FROM toks JOIN surnames USING (key) JOIN lc USING (key) WHERE key <> '' GROUP BY v),
vi AS (
  SELECT vals.v, vals.key, lc.composer, lp.person, coalesce(lp.conductor, false) AS conductor, le.ens_id, le.ens_canonical,
    coalesce(le.has_eras AND NOT le.no_split, false) AS split, le.has_eras, coalesce(le.no_conductor, false) AS no_conductor, pr.key IS NOT NULL AS prot,
    CASE WHEN le.ens_id IS NOT NULL OR lp.person IS NOT NULL THEN NULL WHEN lc.composer IS NOT NULL THEN lc.composer ELSE th.composer END AS named
  FROM vals LEFT JOIN lc ON lc.key = vals.key LEFT JOIN lp ON lp.key = vals.key LEFT JOIN le ON le.key = vals.key
  LEFT JOIN protected pr ON pr.key = vals.key LEFT JOIN tokhit th ON th.v = vals.v),
tp AS (SELECT t.*, vi.prot FROM t JOIN vi ON vi.v = t.albumartist),
ctext AS (SELECT DISTINCT replace(folder, '/', '\\') AS x FROM t UNION SELECT DISTINCT albumartist FROM t),
cgram AS ({_ngrams("ctext", "x")}),
chit AS (SELECT v, min_by(lp.person, (9 - len) * 1000 + start) AS person FROM cgram JOIN lp ON lp.key = gram AND lp.conductor GROUP BY v),
sibc AS (SELECT t.folder_key, t.track_id, vi.person, row_number() OVER (PARTITION BY folder_key ORDER BY upper(relative_path), relative_path) AS rn FROM t JOIN vi ON vi.v = t.conductor AND vi.conductor),
fc AS (
  SELECT t.track_id, coalesce(f.person, a.person, CASE WHEN s1.track_id = t.track_id THEN s2.person ELSE s1.person END) AS hit,
    CASE WHEN f.person IS NOT NULL THEN 'from_folder' WHEN a.person IS NOT NULL THEN 'from_albumartist' ELSE 'from_sibling' END AS src
  FROM t LEFT JOIN chit f ON f.v = replace(t.folder, '/', '\\') LEFT JOIN chit a ON a.v = t.albumartist
  LEFT JOIN sibc s1 ON s1.folder_key = t.folder_key AND s1.rn = 1 LEFT JOIN sibc s2 ON s2.folder_key = t.folder_key AND s2.rn = 2),
segs AS (SELECT folder, i, trim(s) AS s FROM (SELECT folder, unnest(string_split(folder, '/')) AS s, generate_subscripts(string_split(folder, '/'), 1) AS i FROM (SELECT DISTINCT folder FROM t))),
ftext AS (
  SELECT 'stem' AS kind, stem AS x, 0 AS o, stem AS owner FROM (SELECT DISTINCT stem FROM t)
  UNION ALL SELECT 'title', title, 0, title FROM (SELECT DISTINCT title FROM t)
  UNION ALL SELECT 'folder', s, i, folder FROM segs),
fblock AS (SELECT kind, owner, o, x FROM ftext WHERE {K("x")} NOT IN (SELECT key FROM lp UNION SELECT key FROM le)),
ftok AS (SELECT kind, owner, o, i, {K("tok")} AS key FROM (SELECT kind, owner, o, unnest(l) AS tok, generate_subscripts(l, 1) AS i FROM (SELECT *, regexp_split_to_array(x, {FIND_SEP}) AS l FROM fblock))),
fhit AS (SELECT kind, owner, o, i, lc.composer FROM ftok JOIN lc USING (key) WHERE key NOT IN (SELECT key FROM lp UNION SELECT key FROM le)),
tagc AS (SELECT t.track_id, t.folder_key, coalesce(lc.composer, t.composer_t) AS tagged FROM t LEFT JOIN lc ON lc.key = {K("t.composer_t")} WHERE t.composer_t IS NOT NULL),
folderc AS (SELECT folder_key, count(DISTINCT tagged) AS n FROM tagc GROUP BY 1),
uval AS (
  SELECT folder, disc, 'c' AS kind, coalesce(vi.composer, x.v) AS value FROM (SELECT folder, disc, unnest(composer_l) AS v FROM t) x JOIN vi USING (v)
  UNION SELECT folder, disc, 'p', coalesce(vi.person, artist) FROM t JOIN vi ON vi.v = t.artist
  UNION SELECT folder, disc, 'd', CAST(yr AS VARCHAR) FROM t WHERE yr IS NOT NULL
  UNION SELECT folder, disc, 'r', date FROM t WHERE date IS NOT NULL
  UNION SELECT folder, disc, 'e', coalesce('#' || vi.ens_id, albumartist) FROM t JOIN vi ON vi.v = t.albumartist
  UNION SELECT folder, disc, 'a', album FROM t WHERE album IS NOT NULL),
ucount AS (SELECT folder, disc, count(*) AS n_tracks FROM t GROUP BY 1, 2),
units AS (
  SELECT u.folder, u.disc, u.n_tracks,
    coalesce(list_sort(list(value) FILTER (kind = 'c')), []) AS composers, coalesce(list_sort(list(value) FILTER (kind = 'p')), []) AS artists,
    coalesce(list_sort(list(value) FILTER (kind = 'd')), []) AS dates, coalesce(list_sort(list(value) FILTER (kind = 'r')), []) AS raw_dates,
    coalesce(list_sort(list(value) FILTER (kind = 'e')), []) AS albumartists, coalesce(list_sort(list(value) FILTER (kind = 'a')), []) AS albums
  FROM ucount u LEFT JOIN uval USING (folder, disc) GROUP BY 1, 2, 3),
uov AS (
  SELECT u.folder, u.disc, min_by(o.ord, CASE WHEN o.disc IS NULL THEN 1000 ELSE 0 END + o.ord) AS ord
  FROM ucount u JOIN overrides o ON lower(o.folder) = lower(u.folder) AND (o.disc = u.disc OR o.disc IS NULL) GROUP BY 1, 2),
u1 AS (
  SELECT u.*, o.composer AS o_composer, o.work_name AS o_work, o.date AS o_date, coalesce(o.exclude, false) AS o_exclude,
    coalesce(o.composer, CASE WHEN len(composers) = 1 THEN composers[1] END) AS uc
  FROM units u LEFT JOIN uov USING (folder, disc) LEFT JOIN overrides o ON o.ord = uov.ord),
ualb AS (SELECT folder, disc, min_by(work, album) AS work FROM (SELECT u1.folder, u1.disc, x.album, w.work FROM (SELECT folder, disc, unnest(albums) AS album FROM u1) x JOIN u1 USING (folder, disc) JOIN works w ON w.composer = u1.uc AND w.key = {K("x.album")}) GROUP BY 1, 2),
uhead AS (SELECT folder, i * 2 AS o, s AS x FROM segs UNION ALL SELECT folder, i * 2 - 1, trim(split_part(s, '-', 1)) FROM segs WHERE trim(split_part(s, '-', 1)) NOT IN ('', s)),
ufol AS (SELECT u1.folder, u1.disc, max_by(w.work, h.o) AS work FROM u1 JOIN uhead h USING (folder) JOIN works w ON w.composer = u1.uc AND w.key = {K("h.x")} GROUP BY 1, 2),
u2 AS (
  SELECT u1.*, a.work AS wa, f.work AS wf,
    coalesce(o_work, CASE WHEN a.work IS NOT NULL AND f.work IS NOT NULL AND a.work <> f.work THEN NULL ELSE coalesce(a.work, f.work) END) AS uw,
    coalesce(CASE WHEN len(dates) = 1 THEN dates[1] END, o_date) AS ud, CASE WHEN len(artists) = 1 THEN artists[1] END AS ua
  FROM u1 LEFT JOIN ualb a USING (folder, disc) LEFT JOIN ufol f USING (folder, disc) WHERE NOT o_exclude),
udec AS (
  SELECT folder, disc,
    CASE WHEN uc IS NULL OR uw IS NULL THEN 'WorkUnknown' WHEN ud IS NULL THEN 'DateUnknown' WHEN ua IS NULL THEN 'ArtistUnknown' ELSE 'None' END AS hold,
    uc || ': ' || uw || ' - ' || ud || '/' || ua AS name,
    CASE WHEN uc IS NULL THEN CASE WHEN len(composers) = 0 THEN 'composer_missing' ELSE 'composer_split' END
      WHEN uw IS NULL THEN CASE WHEN wa <> wf THEN 'work_disagrees' ELSE 'work_unregistered' END
      WHEN ud IS NULL THEN CASE WHEN len(dates) = 0 THEN 'date_missing' ELSE 'date_split' END
      WHEN ua IS NULL THEN CASE WHEN len(artists) = 0 THEN 'artist_missing' ELSE 'artist_split' END
      WHEN o_work IS NOT NULL THEN 'work_from_override' WHEN wa IS NOT NULL AND wf IS NOT NULL THEN 'work_from_both'
      WHEN wa IS NOT NULL THEN 'work_from_album' ELSE 'work_from_folder' END AS code
  FROM u2)
"""

_EXT = "'(?i)\\.(m4a|flac|mp3|aif|aiff|wav|ogg|opus)$'"
_PLACE = "(regexp_matches(trim(title), '(?i)^track\\s*\\d+$') OR regexp_matches(trim(title), '^\\d+([-_]\\d+)?$') OR regexp_matches(trim(title), '^\\S+\\s*-\\s*\\d+$'))"
_FROM_STEM = "trim(regexp_replace(stem, '^\\d+(-\\d+)?[\\s._-]+', ''))"
_STYLE = """CASE WHEN regexp_matches(title, '^\\d+-\\d+\\.') THEN '5-1.' WHEN regexp_matches(title, '^\\d+\\.') THEN '1.'
  WHEN regexp_matches(title, '^\\d+\\s+\\S') THEN '1 Allegro' WHEN regexp_matches(title, '^\\(\\s*[IVXLC]+[.\\s]') THEN '(I.'
  WHEN regexp_matches(title, '^[IVXLC]+[.\\s]') THEN 'I.' WHEN regexp_matches(title, '^第[０-９0-9一二三四五六七八九十]+楽章') THEN '第N楽章' ELSE 'none' END"""


def _typo_fixed(x: str) -> str:
    for pattern, replacement, _ in fx.TYPOS:
        x = f"regexp_replace({x}, '{pattern}', '{replacement}', 'g')"
    return x


_ALBUM_PREFIX = "regexp_extract(t.album, '^(.+?)\\s*\\d+$', 1)"
_TYPO_ANY = "|".join(p for p, _, _ in fx.TYPOS)
_INSPECTED = [
    ("title", "title"), ("artist", "artist"), ("albumartist", "albumartist"), ("composer", None), ("conductor", "conductor"),
    ("album", "album"), ("genre", "genre"), ("date", "date"), ("tracknumber", "tracknumber"), ("discnumber", "discnumber"),
]


def _all_values() -> str:
    """(track_id, field, v, before) of every value of the ten inspected fields, protected ones left out."""
    parts = []
    for field, column in _INSPECTED:
        guard = "AND NOT prot" if field == "albumartist" else ""
        if column is None:
            parts.append("SELECT track_id, 'composer' AS field, unnest(composer_l) AS v, composer_t AS before FROM tp")
        else:
            parts.append(f"SELECT track_id, '{field}' AS field, {column} AS v, {column} AS before FROM tp WHERE {column} IS NOT NULL {guard}")
    return " UNION ALL ".join(parts)


def _find(rule: str, field: str, before: str, after: str, severity: str, hold: str, code: str, source: str, **args: str) -> str:
    return (
        f"SELECT relative_path, '{field}' AS field, {before} AS before, {after} AS after, '{rule}' AS rule_id, "
        f"{severity} AS severity, {hold} AS hold, {code} AS code, {_args(**args)} AS args FROM {source}"
    )


def _args(**args: str) -> str:
    """The arguments of the evidence as text, by name; those that are null are left out."""
    listed = ", ".join(f"'{k}=' || {v}" for k, v in sorted(args.items()))
    return f"array_to_string(list_filter([{listed}], lambda z: z IS NOT NULL), ', ')" if args else "''"


def _listed(tests: list[tuple[str, str]]) -> str:
    """The texts whose tests hold, joined."""
    listed = ", ".join(f"CASE WHEN {test} THEN {text} END" for test, text in tests)
    return f"array_to_string(list_filter([{listed}], lambda y: y IS NOT NULL), ' / ')"


def _r202(field: str) -> str:
    guard = " AND NOT vi.prot" if field == "albumartist" else ""
    fix = "CASE WHEN person IS NOT NULL THEN person WHEN ens_id IS NOT NULL THEN ens_canonical END"
    return _find(
        "R-202", field, f"t.{field}", f"coalesce({fix}, '')",
        f"CASE WHEN {fix} IS NULL THEN 'Info' ELSE 'Error' END", "'None'",
        f"CASE WHEN {fix} IS NULL THEN 'not_in_dictionary' ELSE 'canonical' END",
        f"t JOIN vi ON vi.v = t.{field} WHERE named IS NULL{guard} AND NOT (person IS NULL AND ens_id IS NOT NULL AND split) "
        f"AND NOT coalesce({fix} = t.{field}, false)", canonical=fix,
    )


def _r207() -> str:
    caps = "regexp_matches(v, '\\b\\p{Lu}{5,}\\b')"
    life = "regexp_matches(v, '\\(?\\s*1[0-9]{3}\\s*[-–]\\s*[12][0-9]{3}\\s*\\)?')"
    order = (
        f"(field <> 'albumartist' AND regexp_matches(v, '^[^,]+,\\s*[^,]+$') AND NOT list_has_any("
        f"list_transform(string_split(v, ','), lambda s: {K('s')}), (SELECT list(key) FROM le)))"
    )
    fields = " UNION ALL ".join(
        [
            "SELECT track_id, relative_path, 'artist' AS field, artist AS v, artist AS before FROM t WHERE artist IS NOT NULL",
            "SELECT track_id, relative_path, 'conductor', conductor, conductor FROM t WHERE conductor IS NOT NULL",
            "SELECT track_id, relative_path, 'albumartist', albumartist, albumartist FROM tp WHERE NOT prot",
            "SELECT track_id, relative_path, 'composer', unnest(composer_l), composer_t FROM t",
        ]
    )
    return (
        f"SELECT relative_path, field, before, '' AS after, 'R-207' AS rule_id, 'Warning' AS severity, 'None' AS hold, 'name_form' AS code, "
        + _args(problems=_listed([(life, "'life_span'"), (order, "'surname_first'"), (caps, "'all_caps'")]), value="v") + " AS args "
        f"FROM ({fields}) x JOIN vi USING (v) WHERE vi.composer IS NULL AND vi.person IS NULL AND vi.ens_id IS NULL AND ({life} OR {order} OR {caps})"
    )


def _r208(field: str) -> str:
    fix = "coalesce(vi.composer, vi.person, vi.ens_canonical)" if field == "composer" else "coalesce(vi.person, vi.ens_canonical)"
    source = f"tp t JOIN vi ON vi.v = t.{field}" if field != "composer" else "tp t JOIN vi ON vi.v = t.composer_l[1] AND len(t.composer_l) = 1"
    guard = " AND NOT t.prot" if field == "albumartist" else ""
    return _find(
        "R-208", field, "vi.v", f"coalesce({fix}, '')", f"CASE WHEN {fix} IS NULL THEN 'Info' ELSE 'Warning' END", "'None'",
        f"CASE WHEN {fix} IS NULL THEN 'no_latin_form' ELSE 'latin_form' END",
        f"{source} WHERE regexp_matches(vi.v, '{JP}'){guard}",
    )


_R210_HIT = "(SELECT min_by(h.composer, h.o * 1000 + h.i) FROM fhit h WHERE h.kind = '{}' AND h.owner = {} AND h.composer <> tagc.tagged)"
_R206_PARTS = "list_filter(list_transform(string_split(v, ';'), lambda p: trim(p)), lambda p: p <> '')"
_R206_UNIQ = f"len(list_distinct(list_transform({_R206_PARTS}, lambda p: upper(p))))"

RULE_SQL = {
    "R-101": _find("R-101", "genre", "genre", "'Classic'", "'Warning'", "'None'", "'genre_fixed'", "t WHERE genre <> 'Classic'"),
    "R-102": _find("R-102", "genre", "''", "'Classic'", "'Warning'", "'None'", "'genre_fixed'", "t WHERE genre IS NULL"),
    "R-103": _find(
        "R-103", "discnumber", "''", "CASE WHEN m THEN '' ELSE '1/1' END", "CASE WHEN m THEN 'Info' ELSE 'Warning' END", "'None'",
        "CASE WHEN m THEN 'several_discs' ELSE 'single_disc' END",
        "(SELECT *, coalesce(bool_or(trim(split_part(discnumber, '/', 1)) <> '1') OVER (PARTITION BY folder_key), false) AS m FROM t) WHERE discnumber IS NULL",
    ),
    "R-104": _find(
        "R-104", "date", "date", "coalesce(CAST(yr AS VARCHAR), '')", "CASE WHEN yr IS NULL THEN 'Info' ELSE 'Warning' END", "'None'",
        "CASE WHEN yr IS NULL THEN 'year_unreadable' ELSE 'year_extracted' END", "t WHERE date IS NOT NULL AND NOT regexp_matches(date, '^\\d{4}$')", date="date",
    ),
    "R-105": _find("R-105", "date", "''", "''", "'Info'", "'None'", "'date_missing'", "t WHERE date IS NULL"),
    "R-201": _find(
        "R-201", "composer", "t.composer_t", "coalesce(vi.composer, '')", "CASE WHEN vi.composer IS NULL THEN 'Info' ELSE 'Error' END", "'None'",
        "CASE WHEN vi.composer IS NULL THEN 'not_in_dictionary' ELSE 'canonical' END",
        "t LEFT JOIN vi ON vi.v = t.composer_l[1] AND len(t.composer_l) = 1 WHERE len(t.composer_l) > 0 AND vi.composer IS DISTINCT FROM t.composer_t",
        canonical="vi.composer",
    ),
    "R-202": " UNION ALL ".join(_r202(f) for f in ("artist", "conductor", "albumartist")),
    "R-203": _find(
        "R-203", "artist", "t.artist", "coalesce(fc.hit, '')", "CASE WHEN fc.hit IS NULL THEN 'Info' ELSE 'Error' END", "'None'",
        "CASE WHEN fc.hit IS NULL THEN 'conductor_unknown' ELSE fc.src END", "t JOIN vi ON vi.v = t.artist JOIN fc USING (track_id) WHERE vi.named IS NOT NULL", composer="vi.named",
    ),
    "R-204": _find(
        "R-204", "albumartist", "t.albumartist", "coalesce(s.ens, '')", "CASE WHEN s.ens IS NULL THEN 'Info' ELSE 'Error' END", "'None'",
        "CASE WHEN s.ens IS NULL THEN 'ensemble_unknown' ELSE 'from_sibling' END",
        "tp t JOIN vi ON vi.v = t.albumartist LEFT JOIN (SELECT folder_key, min_by(v2.ens_canonical, upper(relative_path)) AS ens FROM t JOIN vi v2 ON v2.v = t.albumartist "
        "AND NOT v2.has_eras AND v2.ens_canonical IS NOT NULL GROUP BY 1) s USING (folder_key) WHERE vi.named IS NOT NULL AND NOT t.prot", composer="vi.named",
    ),
    "R-205": (
        "SELECT relative_path, field, any_value(before) AS before, '' AS after, 'R-205' AS rule_id, 'Info' AS severity, 'None' AS hold, "
        f"CASE WHEN field = 'title' THEN 'semicolon_in_title' ELSE 'semicolon' END AS code, '' AS args FROM ({_all_values()}) x JOIN t USING (track_id) "
        "WHERE contains(v, ';') GROUP BY relative_path, field"
    ),
    "R-206": (
        f"SELECT relative_path, field, before, CASE WHEN {_R206_UNIQ} = 1 THEN {_R206_PARTS}[1] ELSE '' END AS after, 'R-206' AS rule_id, "
        f"CASE WHEN {_R206_UNIQ} = 1 THEN 'Error' ELSE 'Info' END AS severity, 'None' AS hold, "
        f"CASE WHEN {_R206_UNIQ} = 1 THEN 'repeated' ELSE 'partly_repeated' END AS code, 'times=' || len({_R206_PARTS}) AS args FROM ({_all_values()}) x JOIN t USING (track_id) "
        f"WHERE len({_R206_PARTS}) >= 2 AND {_R206_UNIQ} < len({_R206_PARTS})"
    ),
    "R-207": _r207(),
    "R-208": " UNION ALL ".join(_r208(f) for f in ("artist", "conductor", "albumartist", "composer")),
    "R-209": _find(
        "R-209", "albumartist", "t.albumartist", "coalesce(e.name, '')", "'Error'", "CASE WHEN e.name IS NULL THEN 'EraUnknown' ELSE 'None' END",
        "CASE WHEN e.name IS NULL THEN 'era_unknown' ELSE 'era_name' END",
        "(SELECT t.*, vi.ens_id FROM tp t JOIN vi ON vi.v = t.albumartist WHERE vi.split AND NOT t.prot) t LEFT JOIN (SELECT track_id, min_by(eras.name, o) AS name FROM t JOIN vi ON vi.v = t.albumartist "
        "JOIN eras ON eras.ens_id = vi.ens_id AND yr IS NOT NULL AND (from_y IS NULL OR yr >= from_y) AND (until_y IS NULL OR yr < until_y) GROUP BY 1) e USING (track_id) "
        "WHERE e.name IS NULL OR e.name <> t.albumartist", entity="t.ens_id", year="CASE WHEN e.name IS NOT NULL THEN t.yr END",
    ),
    "R-210": (
        "SELECT t.relative_path, 'composer' AS field, t.composer_t AS before, '' AS after, 'R-210' AS rule_id, 'Info' AS severity, 'None' AS hold, 'other_composer' AS code, "
        + _args(
            tagged="tagc.tagged", from_file_name=_R210_HIT.format("stem", "t.stem"), from_title=_R210_HIT.format("title", "t.title"),
            from_folder="CASE WHEN folderc.n = 1 THEN " + _R210_HIT.format("folder", "t.folder") + " END",
        ) + " AS args "
        "FROM t JOIN tagc USING (track_id) JOIN folderc ON folderc.folder_key = t.folder_key WHERE "
        "EXISTS (SELECT 1 FROM fhit h WHERE h.kind = 'stem' AND h.owner = t.stem AND h.composer <> tagc.tagged) "
        "OR EXISTS (SELECT 1 FROM fhit h WHERE h.kind = 'title' AND h.owner = t.title AND h.composer <> tagc.tagged) "
        "OR (folderc.n = 1 AND EXISTS (SELECT 1 FROM fhit h WHERE h.kind = 'folder' AND h.owner = t.folder AND h.composer <> tagc.tagged))"
    ),
    "R-301": " UNION ALL ".join(
        _find("R-301", f, f, _typo_fixed(f), "'Error'", "'None'", "'typo'", f"t WHERE regexp_matches({f}, '{_TYPO_ANY}')",
              patterns=_listed([(f"regexp_matches({f}, {_lit(x)})", _lit(x)) for x, _, _ in fx.TYPOS])) for f in ("title", "album")
    ),
    "R-302": _find("R-302", "title", "title", f"trim(regexp_replace(title, {_EXT}, ''))", "'Error'", "'None'", "'extension_in_title'", f"t WHERE regexp_matches(title, {_EXT}) AND trim(regexp_replace(title, {_EXT}, '')) <> ''"),
    "R-303": _find(
        "R-303", "title", "title", "coalesce(s, '')", "'Info'", "'None'", "CASE WHEN s IS NULL THEN 'placeholder_file_name' ELSE 'from_file_name' END",
        f"(SELECT *, CASE WHEN {_FROM_STEM} = '' OR {_PLACE.replace('title', _FROM_STEM)} THEN NULL ELSE {_FROM_STEM} END AS s FROM t) WHERE {_PLACE}",
    ),
    "R-304": _find(
        "R-304", "title", "title", "''", "'Info'", "'None'", "'diacritics'",
        "t WHERE list_has_any(list_transform(regexp_split_to_array(title, '[ \\t,;:/()\\[\\]&.\"''?!]+'), lambda x: lower(x)), "
        "['walkure', 'gotterdammerung', 'tannhauser', 'freischutz', 'sangerkrieg', 'jagervergnugen', 'konig', 'nurnberg'])",
        words=_listed([("contains(lower(title), 'walkure')", "'Walkure'"), ("contains(lower(title), 'tannhauser')", "'Tannhauser'")]),
        suggestion="replace(replace(title, 'Walkure', 'Walküre'), 'Tannhauser', 'Tannhäuser')",
    ),
    "R-401": _find(
        "R-401", "composer", "''", "coalesce(sib, fld, pth, '')", "CASE WHEN coalesce(sib, fld, pth) IS NULL THEN 'Info' ELSE 'Error' END", "'None'",
        "CASE WHEN sib IS NOT NULL THEN 'from_sibling' WHEN fld IS NOT NULL THEN 'from_field' WHEN pth IS NOT NULL THEN 'from_folder' ELSE 'composer_unknown' END",
        f"""(SELECT t.*, CASE WHEN s.n = 1 THEN lc.composer END AS sib, coalesce(a.named, aa.named) AS fld, p.composer AS pth FROM t
        LEFT JOIN (SELECT folder_key, count(DISTINCT v) AS n, min(v) AS v FROM (SELECT folder_key, unnest(composer_l) AS v FROM t) GROUP BY 1) s USING (folder_key)
        LEFT JOIN lc ON lc.key = {K('s.v')} LEFT JOIN vi a ON a.v = t.artist LEFT JOIN vi aa ON aa.v = t.albumartist
        LEFT JOIN (SELECT folder, min_by(lc.composer, pos) AS composer FROM (
          SELECT folder, i * 1000 AS pos, {K('s')} AS key FROM segs
          UNION ALL SELECT folder, i * 1000 + j, {K('tok')} FROM (SELECT folder, i, unnest(l) AS tok, generate_subscripts(l, 1) AS j FROM (SELECT folder, i, regexp_split_to_array(s, {FIND_SEP}) AS l FROM segs))) JOIN lc USING (key) GROUP BY 1) p ON p.folder = t.folder
        WHERE len(t.composer_l) = 0)""",
    ),
    "R-402": _find(
        "R-402", "conductor", "''", "coalesce(c, hit, '')", "CASE WHEN coalesce(c, hit) IS NULL THEN 'Info' ELSE 'Error' END", "'None'",
        "CASE WHEN c IS NOT NULL THEN 'from_artist' WHEN hit IS NOT NULL THEN src ELSE 'conductor_unknown' END",
        "(SELECT t.*, CASE WHEN vi.conductor THEN vi.person END AS c, fc.hit, fc.src FROM t LEFT JOIN vi ON vi.v = t.artist JOIN fc USING (track_id) WHERE t.conductor IS NULL "
        "AND NOT coalesce(CASE WHEN vi.ens_id IS NOT NULL THEN vi.no_conductor ELSE vi.person IS NOT NULL AND NOT vi.conductor END, false))",
    ),
    "R-501": _find(
        "R-501", "album", "t.album", "''", "'Warning'", "'None'", "'mixed_composers'",
        "t JOIN (SELECT album, count(DISTINCT tagged) AS n, min(tagged) AS lowest, max(tagged) AS highest FROM t JOIN tagc USING (track_id) GROUP BY 1 HAVING n >= 2) m ON m.album = t.album "
        "LEFT JOIN uov ON uov.folder = t.folder AND uov.disc = t.disc LEFT JOIN overrides o ON o.ord = uov.ord WHERE NOT (coalesce(o.exclude, false) OR o.composer IS NOT NULL)",
        n_composers="m.n", first="m.lowest", last="m.highest",
    ),
    "R-502": _find(
        "R-502", "album", "album", "''", "'Info'", "'None'", "CASE WHEN lc.composer IS NULL THEN 'japanese_album' ELSE 'japanese_short_name' END",
        f"t LEFT JOIN lc ON lc.key <> '' AND lc.key = {K(_ALBUM_PREFIX)} WHERE regexp_matches(album, '{JP}')",
        composer="lc.composer", number="CASE WHEN lc.composer IS NOT NULL THEN regexp_extract(album, '(\\d+)$', 1) END",
    ),
    "R-503": _find(
        "R-503", "title", "title", "''", "'Info'", "'None'", "'mixed_styles'",
        f"(SELECT *, count(*) OVER (PARTITION BY folder_key) AS nt, count(DISTINCT st) OVER (PARTITION BY folder_key) AS ns FROM (SELECT *, {_STYLE} AS st FROM t)) JOIN (SELECT folder_key, array_to_string(list_sort(list(DISTINCT {_STYLE})), ' / ') AS sts FROM t GROUP BY 1) USING (folder_key) WHERE nt >= 2 AND ns >= 2",
        style="st", styles="sts",
    ),
    "R-504": _find(
        "R-504", "album", "coalesce(t.album, '')", "CASE WHEN d.hold = 'None' THEN d.name ELSE '' END", "'Warning'", "d.hold", "d.code",
        "t JOIN udec d USING (folder, disc) JOIN u2 USING (folder, disc) WHERE d.hold <> 'None' OR t.album IS DISTINCT FROM d.name",
        work="u2.uw", first_album="u2.albums[1]", override_date="CASE WHEN len(u2.dates) <> 1 THEN u2.o_date END",
    ),
    # No CP932 decoder here: the misread texts of the fixture and what they stand for, listed.
    "R-403": (
        "SELECT relative_path, field, before, '' AS after, 'R-403' AS rule_id, 'Info' AS severity, 'None' AS hold, 'mojibake' AS code, 'decoded=' || m.decoded AS args "
        f"FROM ({_all_values()}) x JOIN t USING (track_id) JOIN (VALUES ({_lit(fx.MISREAD)}, 'カラヤン')) m(misread, decoded) ON m.misread = x.v AND x.v = x.before"
    ),
}
#: The rules with the arguments of their evidence.
_WITH_ARGS = RULE_SQL
RULE_SQL = {rule: f"SELECT * EXCLUDE (args) FROM ({sql})" for rule, sql in _WITH_ARGS.items()}
#: Rules that clear a value instead of naming a new one.
_CLEARS = "(rule_id = 'R-403' AND before <> '')"


def with_prelude(body: str) -> str:
    return PRELUDE + body


def changes_sql(rules: list[str]) -> str:
    """The findings with their derived columns, as a subquery."""
    union = " UNION ALL ".join(f"SELECT * FROM ({_WITH_ARGS[r]})" for r in rules)
    fix = f"(hold = 'None' AND (after <> '' AND after <> before OR {_CLEARS}))"
    return f"(SELECT *, {fix} AS fix, {fix} AND severity <> 'Info' AS selected FROM ({union}))"


# ---- everything but the single rules ---------------------------------------------------------

_FIELDS = ["title", "artist", "albumartist", "composer", "conductor", "album", "genre", "date", "tracknumber", "discnumber", "comment"]


def _text(f: str) -> str:
    return {"composer": "coalesce(composer_t, '')", "comment": "''"}.get(f, f"coalesce({f}, '')")


_CURRENT = " UNION ALL ".join(
    f"SELECT track_id, relative_path, '{f}' AS field, {i} AS field_ord, {_text(f)} AS before, "
    + ("len(composer_l)" if f == "composer" else "0" if f == "comment" else f"CASE WHEN {f} IS NULL THEN 0 ELSE 1 END")
    + " AS n FROM t"
    for i, f in enumerate(_FIELDS)
)
# Manual edits: the log, the last entry per field, resets, no-ops out.
_EDITS = f""",
cur AS ({_CURRENT}),
elog AS (
  SELECT track_id, track_id * 2 AS seq, ['genre', 'artist', 'date', 'albumartist', 'discnumber'][track_id % 5 + 1] AS field,
    ['Classic', ' Karl Böhm ', NULL, 'カラヤン', '1-1', 'Brahms', 'New; Name'][track_id % 7 + 1] AS value, CASE WHEN track_id % 2 = 0 THEN 3 ELSE 1 END AS bulk FROM t
  UNION ALL SELECT track_id, track_id * 2 + 1, CASE WHEN track_id % 3 = 0 THEN NULL WHEN track_id % 3 = 1 THEN 'genre' ELSE 'composer' END,
    CASE WHEN track_id % 9 = 4 THEN NULL ELSE 'Classic' END, 1 FROM t),
elast AS (
  SELECT track_id, field, max_by(coalesce(trim(value), ''), seq) AS value, max_by(bulk, seq) AS bulk, max(seq) AS seq FROM elog WHERE field IS NOT NULL GROUP BY 1, 2),
edits AS (
  SELECT c.track_id, c.relative_path, c.field, c.field_ord, c.before, c.n, e.value, e.bulk
  FROM elast e JOIN cur c USING (track_id, field) LEFT JOIN (SELECT track_id, max(seq) AS at FROM elog WHERE field IS NULL GROUP BY 1) r USING (track_id)
  WHERE (r.at IS NULL OR e.seq > r.at) AND NOT CASE WHEN e.value = '' THEN c.n = 0 ELSE c.n = 1 AND c.before = e.value END)
"""
_MANUAL = "SELECT relative_path, field, before, value AS after, 'MANUAL' AS rule_id, value = '' AS clears FROM edits"


def _proposals(rules: list[str], edits: bool = True) -> str:
    rule_part = f"SELECT relative_path, field, before, after, rule_id, false AS clears FROM {changes_sql(rules)} WHERE selected"
    both = rule_part + (f" UNION ALL {_MANUAL}" if edits else "")
    return f"""
, prop AS (SELECT *, CASE WHEN clears THEN '(clear)' ELSE after END AS shown FROM ({both})),
res AS (
  SELECT relative_path, field, count(*) AS n, count(DISTINCT shown) AS d, count_if(rule_id = 'MANUAL') AS m, min_by(after, rule_id) AS first,
    min(after) FILTER (rule_id = 'MANUAL') AS edit, string_agg(rule_id || ' -> ' || shown, ' / ' ORDER BY rule_id, shown) AS proposals
  FROM prop GROUP BY 1, 2),
plan AS (SELECT relative_path, field, CASE WHEN d = 1 THEN first ELSE edit END AS new_values FROM res WHERE d = 1 OR m = 1)
"""


def _unit_reports() -> dict[str, str]:
    single = "SELECT composers[1] AS composer, artists[1] AS artist, raw_dates[1] AS date, n_tracks FROM units WHERE len(composers) = 1 AND len(artists) = 1 AND len(raw_dates) = 1"
    fields = [("composer", "composers"), ("date", "raw_dates"), ("artist", "artists"), ("albumartist", "albumartists"), ("album", "albums")]
    sole_a = "CASE WHEN len(artists) = 0 THEN '-' ELSE array_to_string(artists, '+') END"
    sole_d = "CASE WHEN len(raw_dates) = 0 THEN '-' ELSE array_to_string(raw_dates, '+') END"
    per_folder = "(SELECT lower(folder) AS fk, min(folder) AS folder, count(*) AS n, sum(n_tracks) AS files, string_agg(CAST(disc AS VARCHAR), ', ' ORDER BY disc) AS discs FROM units GROUP BY 1)"
    return {
        "inventory": f"SELECT sum(files) AS files, count(*) AS folders, sum(n) AS units, count_if(n > 1) AS multi_disc_folders, "
        f"coalesce(sum(n) FILTER (n > 1), 0) AS units_below, coalesce(sum(files) FILTER (n > 1), 0) AS files_below FROM {per_folder}",
        "multi_disc_folders": f"SELECT folder, n AS n_units, files AS n_files, discs FROM {per_folder} WHERE n > 1",
        "coherence": " UNION ALL ".join(
            f"SELECT '{f}' AS field, count_if(len({c}) = 0) AS none, count_if(len({c}) = 1) AS one, count_if(len({c}) >= 2) AS several FROM units" for f, c in fields
        ),
        "collision_candidates": f"SELECT composer, artist, date, count(*) AS n_units, sum(n_tracks) AS n_files FROM ({single}) GROUP BY 1, 2, 3 HAVING count(*) >= 2",
        "merged_groups": "SELECT count(*) AS merged_groups FROM (SELECT 1 FROM units WHERE len(composers) = 1 AND len(albums) = 1 GROUP BY composers[1], albums[1] HAVING count(*) >= 2)",
        "performer_collisions": f"SELECT albumartists[1] AS ensemble, count(*) AS n_units, array_to_string(list_sort(list(DISTINCT {sole_a})), ' / ') AS artists FROM units WHERE len(albumartists) = 1 GROUP BY 1 HAVING count(DISTINCT {sole_a}) >= 2",
        "performer_dates": f"SELECT albumartists[1] AS ensemble, artists[1] AS artist, count(*) AS n_units, array_to_string(list_sort(list(DISTINCT {sole_d})), ' / ') AS dates FROM units WHERE len(albumartists) = 1 AND len(artists) = 1 GROUP BY 1, 2 HAVING count(DISTINCT {sole_d}) >= 2",
        "album_units": "SELECT folder, disc, n_tracks, " + ", ".join(f"array_to_string({c}, '; ') AS {c}" for c in ("composers", "artists", "dates", "albums")) + " FROM units",
        "album_names": "SELECT folder, disc, hold AS unit_hold, CASE WHEN hold = 'None' THEN name END AS unit_album, code AS unit_code FROM udec",
    }


def other_sql(rules: list[str]) -> dict[str, str]:
    all_changes = changes_sql(rules)
    counts = "count(*) AS found, count_if(fix) AS fixable, count_if(selected) AS selected, count_if(hold <> 'None') AS held"
    category = "CASE WHEN field = 'composer' THEN 'composer' WHEN field = 'albumartist' THEN 'ensemble' ELSE 'person' END"
    ordinal = "list_position(['title','artist','albumartist','composer','conductor'], field)"
    why = "code || CASE WHEN args = '' THEN '' ELSE ' (' || args || ')' END"
    after = f"CASE WHEN {_CLEARS} THEN '(clear)' WHEN fix THEN after ELSE '' END"
    missing = ", ".join(
        f"count_if({'len(composer_l) = 0' if f == 'composer' else f + ' IS NULL'}) AS missing_{f}" for f in _FIELDS if f != "comment"
    )
    semis = " OR ".join(f"contains(coalesce({f}, ''), ';')" for f in _FIELDS if f not in ("composer", "comment"))
    empty = " OR ".join(f"{f} IS NULL" if f != "composer" else "len(composer_l) = 0" for f in _FIELDS if f != "comment")
    haystack = " || chr(10) || ".join(["relative_path"] + [_text(f) for f in _FIELDS])
    out = {
        "rule_summary": f"SELECT rule_id, {counts} FROM {all_changes} GROUP BY ROLLUP (rule_id)",
        "unknown_values": f"""SELECT before AS value, {category} AS category, count(DISTINCT relative_path) AS n_paths,
          array_to_string(list_transform(list_sort(list(DISTINCT {ordinal})), lambda i: ['title','artist','albumartist','composer','conductor'][i]), ' / ') AS fields,
          min_by(relative_path, rule_id || upper(relative_path) || {ordinal}) AS sample_path, string_agg(DISTINCT rule_id, ' / ' ORDER BY rule_id) AS rules
          FROM {changes_sql(["R-201", "R-202"])} WHERE NOT fix AND hold = 'None' AND before <> '' GROUP BY 1, 2""",
        "top_findings": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY n DESC, field, before_text, after_text, rationale) AS rank FROM (
          SELECT rule_id, field, before AS before_text, {after} AS after_text, {why} AS rationale, count(*) AS n FROM {all_changes} GROUP BY ALL)) WHERE rank <= 8""",
        "selection": f"""SELECT rule_id, count(*) AS found, count_if(CASE WHEN fix AND starts_with(lower(relative_path), 'brahms/') THEN NOT selected ELSE selected END) AS selected
          FROM {all_changes} GROUP BY 1""",
        "folder_tree": """SELECT anc AS folder, count(*) AS n_files FROM (SELECT unnest(['', split_part(folder, '/', 1), folder]) AS anc FROM t) GROUP BY 1""",
        "library_stats": f"SELECT count(*) AS n_tracks, {missing}, count_if(len(composer_l) > 1) AS multi_value_rows, "
        f"count_if({semis} OR contains(array_to_string(composer_l, ''), ';')) AS semicolon_rows, count_if(false) AS wrong_conductor_key FROM t",
        "format_counts": "SELECT 'Flac' AS format, count(*) AS n_tracks FROM t",
        "verify": _proposals(rules, edits=False) + f", cur AS ({_CURRENT}) SELECT relative_path, field, new_values AS expected, before AS actual FROM plan JOIN cur USING (relative_path, field)",
        "apply_plan": _EDITS + _proposals(rules) + "SELECT * FROM plan",
        "apply_conflicts": _EDITS + _proposals(rules) + "SELECT relative_path, field, proposals, m = 1 AS resolved, CASE WHEN m = 1 THEN edit END AS adopted FROM res WHERE d > 1",
        "apply_overlay": _EDITS + _proposals(rules) + "SELECT t.relative_path, "
        + ", ".join(f"coalesce(max(p.new_values) FILTER (p.field = '{f}'), any_value({_text(f)})) AS {f}" for f in _FIELDS)
        + " FROM t LEFT JOIN plan p ON p.relative_path = t.relative_path GROUP BY 1",
        "remaining_findings": _EDITS + _proposals(rules) + f"""SELECT rule_id, count(*) AS n FROM (
          SELECT relative_path, field, rule_id FROM {all_changes} UNION ALL SELECT relative_path, field, 'MANUAL' FROM edits) x
          WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.relative_path = x.relative_path AND res.field = x.field AND res.d = 1) GROUP BY 1""",
        "restore_plan": "SELECT relative_path, 'genre' AS field, coalesce(genre, '') AS current, 'Old' AS snapshot FROM t WHERE track_id % 37 = 0 AND track_id % 31 <> 0",
        "apply_counters": _EDITS + _proposals(rules) + """, paths AS (SELECT relative_path, count_if(d = 1 OR m = 1) AS n, ends_with(relative_path, 'Track04.flac') AS bad FROM res GROUP BY 1)
          SELECT t.folder, count(p.n) AS attempted, count_if(p.n > 0 AND NOT bad) AS succeeded, CAST(coalesce(sum(p.n) FILTER (p.n > 0 AND NOT bad), 0) AS BIGINT) AS applied, count_if(p.n > 0 AND bad) AS failed
          FROM t LEFT JOIN paths p USING (relative_path) GROUP BY 1""",
        "restore_applied": """SELECT folder, count_if(x) AS attempted, count_if(x AND NOT bad) AS succeeded, count_if(x AND NOT bad) AS applied, count_if(x AND bad) AS failed
          FROM (SELECT folder, track_id % 37 = 0 AND track_id % 31 <> 0 AS x, ends_with(relative_path, 'Track04.flac') AS bad FROM t) GROUP BY 1""",
        "verify_partly": _proposals(rules, edits=False) + f", cur AS ({_CURRENT}) SELECT relative_path, field, new_values AS expected, before AS actual FROM plan JOIN cur USING (relative_path, field) WHERE track_id % 3 = 0",
        "natural_sort_key": """SELECT relative_path, row_number() OVER (ORDER BY list_transform(regexp_extract_all(relative_path, '([0-9]+|[^0-9]+)'), lambda r:
            CASE WHEN regexp_matches(r, '^[0-9]') THEN {'kind': 0, 'size': length(ltrim(r, '0')), 'digits': ltrim(r, '0'), 'padded': length(r), 'text': ''}
            ELSE {'kind': 1, 'size': 0, 'digits': '', 'padded': 0, 'text': lower(r)} END)) - 1 AS place FROM t""",
        "register_works": """SELECT CASE WHEN v = 1 THEN folder || '!' ELSE folder END AS folder, CASE WHEN v = 2 THEN NULL ELSE disc END AS disc, name,
            CASE WHEN v > 0 THEN 'no_unit' WHEN name = ' ' THEN 'no_name' END AS problem,
            CASE WHEN v = 0 AND len(an) > 0 AND len(fn) > 0 AND NOT list_has_any(an, fn) THEN 'numbers_disagree' END AS warning
          FROM (SELECT folder, disc, unnest([0, 1, 2]) AS v, CASE WHEN n_tracks % 5 = 0 THEN ' ' ELSE 'Work ' || (n_tracks % 7) END AS name,
            list_filter(flatten(list_transform(albums, lambda a: regexp_extract_all(a, '[0-9]+'))), lambda x: length(x) <= 3) AS an,
            list_filter(regexp_extract_all(regexp_extract(folder, '([^/]*)$', 1), '[0-9]+'), lambda x: length(x) <= 3) AS fn FROM units)""",
        "override_checks": """SELECT folder, disc, CASE WHEN NOT x THEN c END AS composer, CASE WHEN NOT x THEN d END AS date, x AS exclude,
            CASE WHEN disc >= 3 THEN 'not_held' WHEN n_tracks % 11 = 0 THEN 'no_note' WHEN NOT x AND c IS NULL AND d IS NULL THEN 'no_effect'
              WHEN x AND n_tracks % 4 = 0 THEN 'exclude_not_offered' WHEN NOT x AND d = '75' THEN 'year_form'
              WHEN NOT x AND d IS NOT NULL AND NOT list_contains(dates, d) THEN 'date_not_in_unit'
              WHEN NOT x AND c IS NOT NULL AND NOT list_contains(composers, c) THEN 'composer_not_offered' END AS problem
          FROM (SELECT *, CASE n_tracks % 3 WHEN 0 THEN composers[1] WHEN 1 THEN 'Nobody' END AS c, CASE n_tracks % 5 WHEN 0 THEN dates[1] WHEN 1 THEN '1804' WHEN 2 THEN '75' END AS d, n_tracks % 7 = 0 AS x FROM units)""",
        "restore_missing": "SELECT relative_path FROM t WHERE track_id % 31 = 0",
        "restore_added": "SELECT relative_path FROM t WHERE track_id % 31 = 0",
        "manual_edits": _EDITS + "SELECT relative_path, field, before, value AS after, value = '' AS clears, CASE WHEN bulk > 1 THEN 'bulk_edit' ELSE 'edit' END AS code FROM edits",
        "edit_warnings": _EDITS + f""", ev AS (
          SELECT e.*, {K('e.value')} AS key, p.prot FROM edits e JOIN tp p USING (track_id)),
          ek AS (SELECT ev.*, lc.composer, lp.person, le.ens_id FROM ev LEFT JOIN lc ON lc.key = ev.key LEFT JOIN lp ON lp.key = ev.key LEFT JOIN le ON le.key = ev.key),
          en AS (SELECT *, value <> '' AND field IN ('artist', 'albumartist', 'composer', 'conductor') AS nm, value <> '' AND field <> 'composer' AND person IS NULL AND ens_id IS NULL AND composer IS NOT NULL AS cn FROM ek)
          SELECT relative_path, field, unnest(list_filter([
            CASE WHEN field = 'albumartist' AND prot THEN 'protected' END, CASE WHEN n > 1 THEN 'collapses_values' END,
            CASE WHEN contains(value, ';') THEN 'semicolon' END, CASE WHEN field = 'genre' AND value NOT IN ('', 'Classic') THEN 'genre_fixed' END,
            CASE WHEN field = 'date' AND value <> '' AND NOT regexp_matches(value, '^\\d{{4}}$') THEN 'date_form' END,
            CASE WHEN field = 'discnumber' AND value <> '' AND NOT regexp_matches(value, '^\\d+/\\d+$') THEN 'number_form' END,
            CASE WHEN nm AND regexp_matches(value, '{JP}') THEN 'japanese_name' END, CASE WHEN nm AND cn THEN 'composer_name' END,
            CASE WHEN nm AND NOT cn AND composer IS NULL AND person IS NULL AND ens_id IS NULL THEN 'not_in_dictionary' END], lambda x: x IS NOT NULL)) AS code FROM en""",
        "change_export": f"""SELECT rule_id AS rule, severity, CASE WHEN hold <> 'None' THEN 'held' WHEN selected THEN 'confirmed' ELSE 'review' END AS classification,
          CASE WHEN selected THEN 'o' ELSE '' END AS selected, relative_path AS path, regexp_extract(relative_path, '^(.*)/', 1) AS folder,
          regexp_extract(relative_path, '([^/]*)$', 1) AS file, field, before, {after} AS after, {why} AS rationale FROM {all_changes}""",
        "summary_export": f"SELECT rule_id AS rule, count(*) AS found, count_if(selected) AS selected, count_if(hold <> 'None') AS held FROM {all_changes} GROUP BY 1",
        "track_export": _EDITS + """SELECT relative_path AS path, folder, file, 'Flac' AS format,
          CASE WHEN EXISTS (SELECT 1 FROM edits e WHERE e.track_id = t.track_id) THEN 'o' ELSE '' END AS edited, CASE WHEN len(composer_l) > 1 THEN 'o' ELSE '' END AS multiple, """
        + ", ".join(f"coalesce(x.e_{f}, {_text(f)}) AS {f}" for f in _FIELDS)
        + " FROM t LEFT JOIN (SELECT track_id AS tid, " + ", ".join(f"max(value) FILTER (field = '{f}') AS e_{f}" for f in _FIELDS) + " FROM edits GROUP BY 1) x ON x.tid = t.track_id",
        "row_filters": f"SELECT starts_with(folder_key, 'brahms/') OR folder_key = 'brahms' AS in_scope, ({empty}) AS has_empty, contains(upper({haystack}), 'KARAJAN') AS has_text, count(*) AS n FROM t GROUP BY 1, 2, 3",
        "scan": "SELECT regexp_replace(relative_path, '\\.flac$', CASE track_id % 7 WHEN 0 THEN '.m4a' WHEN 1 THEN '.MP3' ELSE '.flac' END) AS relative_path, "
        "CASE WHEN contains(relative_path, 'Track04') THEN NULL WHEN track_id % 7 = 0 THEN 'M4a' WHEN track_id % 7 = 1 THEN 'Id3' ELSE 'Flac' END AS format, "
        + ", ".join(f"CASE WHEN contains(relative_path, 'Track04') THEN NULL ELSE {_text(f)} END AS {f}" for f in _FIELDS)
        + ", CASE WHEN contains(relative_path, 'Track04') THEN 'cannot read' END AS message FROM t WHERE NOT starts_with(relative_path, 'Dvorak')",
        "name_keys": f"SELECT v AS value, count(*) AS n, {K('v')} AS key FROM (SELECT unnest(list_concat([artist, albumartist, conductor, album, title], composer_l)) AS v FROM t) WHERE v IS NOT NULL GROUP BY 1",
        "typo_trial": "SELECT title AS before, regexp_replace(title, '\\bAllgro\\b', 'Allegro', 'g') AS after, count(*) AS n FROM t WHERE regexp_matches(title, '\\bAllgro\\b') GROUP BY 1, 2",
        "alias_hints": f"""SELECT DISTINCT folder, hint FROM (SELECT folder, s, unnest([s, CASE WHEN trim(split_part(s, '-', 1)) NOT IN ('', s) THEN trim(split_part(s, '-', 1)) END]) AS hint FROM segs
          WHERE {K('s')} NOT IN (SELECT key FROM lc)) WHERE hint IS NOT NULL AND {K('hint')} <> '' AND {K('hint')} NOT IN (SELECT key FROM lc)""",
        **_unit_reports(),
    }
    return {name: with_prelude(body) for name, body in out.items()} | {
        name: _DERIVED + body for name, body in dictionary_sql().items()
    }


# ---- dictionary jobs over the derived dictionary -------------------------------------------------


def _md5(x: str) -> str:
    return f"md5(CAST({x} AS VARCHAR))"


_CA = f"'Ca ' || substr({_md5('k % 1300')}, 1, 10)"
_AL = f"'AL-' || substr({_md5('k % 1200')}, 1, 8)"
_AL_USER = f"'Al ' || substr({_md5('k % 1100')}, 1, 8)"
_DERIVED = f"""
WITH cust AS (SELECT c_custkey AS k FROM customer), supp AS (SELECT s_suppkey AS k FROM supplier), prt AS (SELECT p_partkey AS k FROM part),
comp AS (SELECT k AS ord, {_CA} AS canonical, [{_AL}, upper({_CA}), replace({_CA}, ' ', '')] AS aliases FROM cust),
ucomp AS (SELECT k AS ord, {_CA} AS canonical, [{_AL_USER}, upper({_CA}), replace({_CA}, ' ', '')] AS aliases FROM cust WHERE k % 3 <> 0),
pers AS (SELECT k AS ord, 'Pe ' || {_md5('k')} AS canonical, CASE WHEN k % 5 = 0 THEN [] WHEN k % 7 = 0 THEN ['Dancer'] ELSE ['Conductor'] END AS roles,
  ['AL-' || substr({_md5('k')}, 1, 8)] AS aliases FROM supp),
ens AS (SELECT k AS ord, 'e' || CAST(k % 1900 AS VARCHAR) AS entity_id, CASE WHEN k % 3 = 0 THEN NULL ELSE 'En ' || {_md5('k')} END AS canonical,
  CASE WHEN k % 4 = 0 THEN 'Ea ' || {_md5('k')} END AS era_a, CASE WHEN k % 4 = 0 THEN 'Eb ' || {_md5('k')} END AS era_b, 1940 + k % 3 * 10 AS from_b,
  k % 5 = 0 AS no_split, k % 11 = 0 AS no_cond FROM prt),
wrk AS (SELECT k AS ord, CASE WHEN k % 50 = 1 THEN 'Cb ' || substr({_md5('k % 1300')}, 1, 10) WHEN k % 50 = 2 THEN 'Nobody ' || {_md5('k')} ELSE {_CA} END AS composer,
  CASE WHEN k % 60 = 0 THEN '' ELSE 'Opus ' || CAST(k % 4 AS VARCHAR) END AS canonical, ['op' || CAST(k % 6 AS VARCHAR), 'OPUS' || CAST(k % 4 AS VARCHAR)] AS aliases FROM prt),
ovr AS (SELECT o_orderkey AS k FROM orders),
typ AS (SELECT n_nationkey AS ord, CASE WHEN n_nationkey % 8 = 0 THEN '(' || n_nationkey ELSE 'x' || n_nationkey END AS pattern, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'y' END AS replacement FROM nation),
prot AS (SELECT k AS ord, CASE WHEN k % 40 = 0 THEN '!!' ELSE 'Pr ' || CAST(k % 80 AS VARCHAR) END AS value FROM supp),
named AS (
  SELECT category, ord, owner, name, seq, source, {K("name")} AS key FROM (
    SELECT 'composer' AS category, ord, canonical AS owner, unnest(list_concat([canonical], aliases)) AS name, unnest(range(0, 4)) AS seq, unnest(['canonical', 'alias', 'alias', 'alias']) AS source FROM comp
    UNION ALL SELECT 'person', ord, canonical, unnest(list_concat([canonical], aliases)), unnest([0, 1]), unnest(['canonical', 'alias']) FROM pers
    UNION ALL SELECT 'ensemble', ord, coalesce(canonical, era_a, entity_id), unnest([era_a, era_b, canonical]), unnest([0, 1, 2]), unnest(['era', 'era', 'canonical']) FROM ens)
  WHERE name IS NOT NULL),
firsts AS (SELECT category, key, min_by(owner, ord * 10 + seq) AS owner, min(ord * 10 + seq) AS pos FROM named WHERE key <> '' GROUP BY 1, 2),
wnames AS (SELECT ord, composer, canonical, composer || ': ' || canonical AS label, name, seq, {K("name")} AS key FROM (
  SELECT ord, composer, canonical, unnest(list_concat([canonical], aliases)) AS name, unnest([0, 1, 2]) AS seq FROM wrk WHERE canonical <> '')),
wfirst AS (SELECT composer, key, min_by(canonical, ord * 10 + seq) AS owner, min(ord * 10 + seq) AS pos FROM wnames GROUP BY 1, 2)
"""


def dictionary_sql() -> dict[str, str]:
    wl = "composer || ': ' || CASE WHEN canonical = '' THEN '(blank)' ELSE canonical END"
    label = "coalesce(canonical, era_a, entity_id)"
    folder = "CASE WHEN k % 100 = 0 THEN '' ELSE 'f/' || k END"
    rows = [
        ("warning", "person", "canonical", "'no_role'", "''", "pers WHERE len(roles) = 0"),
        ("error", "person", "canonical", "'role_unknown'", "roles[1]", "pers WHERE roles = ['Dancer']"),
        ("error", "ensemble", label, "'entity_id_repeated'", "entity_id", "ens e WHERE ord > (SELECT min(ord) FROM ens x WHERE x.entity_id = e.entity_id)"),
        ("error", "ensemble", label, "'no_name'", "''", "ens WHERE canonical IS NULL AND era_a IS NULL"),
        ("error", "ensemble", label, "'no_split_without_name'", "''", "ens WHERE canonical IS NULL AND era_a IS NOT NULL AND no_split"),
        ("warning", "ensemble", label, "'name_and_eras'", "''", "ens WHERE canonical IS NOT NULL AND era_a IS NOT NULL AND NOT no_split"),
        ("warning", "ensemble", label, "CASE WHEN from_b < 1950 THEN 'eras_overlap' ELSE 'eras_gap' END",
         "era_a || ' (~1950) / ' || era_b || ' (' || from_b || '~)'", "ens WHERE era_a IS NOT NULL AND from_b <> 1950"),
        ("error", "typo", "pattern", "'pattern_invalid'", "''", "typ WHERE pattern LIKE '(%'"),
        ("warning", "typo", "pattern", "'replacement_empty'", "''", "typ WHERE pattern NOT LIKE '(%' AND replacement = ''"),
        ("error", "protected", "'(blank)'", "'value_empty'", "''", "prot WHERE value = '!!'"),
        ("warning", "protected", "value", "'value_repeated'", "''", "prot p WHERE value <> '!!' AND ord > (SELECT min(ord) FROM prot x WHERE x.value = p.value)"),
        ("error", "work", wl, "'name_empty'", "''", "wrk WHERE canonical = ''"),
        ("error", "work", wl, "'composer_unknown'",
         "CASE WHEN ca IS NULL THEN '' ELSE ca || ' @2' END",
         "(SELECT wrk.*, CASE WHEN composer LIKE 'Cb %' THEN (SELECT any_value(c.canonical) FROM comp c WHERE c.canonical = 'Ca ' || substr(wrk.composer, 4)) END AS ca FROM wrk WHERE composer NOT IN (SELECT canonical FROM comp))"),
        ("error", "work", wl, "'work_repeated'", "''",
         "(SELECT *, row_number() OVER (PARTITION BY composer, canonical ORDER BY ord) AS rn FROM wrk WHERE canonical <> '') WHERE rn > 1"),
        ("error", "override", "'(blank)'", "'folder_empty'", "''", f"ovr WHERE {folder} = ''"),
        ("warning", "override", folder, "'no_effect'", "''", f"ovr WHERE {folder} <> '' AND k % 9 <> 0 AND k % 4 <> 0 AND k % 6 > 1"),
        ("error", "override", folder, "'year_form'", "'19xx'", f"ovr WHERE {folder} <> '' AND k % 6 = 0"),
        ("warning", "override", folder, "'note_empty'", "''", f"ovr WHERE {folder} <> '' AND k % 7 = 0"),
    ]
    issues = " UNION ALL ".join(
        f"SELECT '{s}' AS severity, '{c}' AS category, {t} AS target, {code} AS code, {d} AS detail FROM {src}" for s, c, t, code, d, src in rows
    )
    clash = """
      UNION ALL SELECT CASE WHEN n.owner = f.owner THEN 'warning' ELSE 'error' END, n.category, n.owner, CASE WHEN n.owner = f.owner THEN 'alias_repeated' ELSE 'alias_used' END,
        CASE WHEN n.owner = f.owner THEN n.name ELSE n.name || ' <- ' || f.owner END FROM named n JOIN firsts f USING (category, key) WHERE n.ord * 10 + n.seq > f.pos
      UNION ALL SELECT 'warning', a.category, a.owner, 'also_in_category', b.category || ': ' || b.owner FROM firsts a JOIN firsts b USING (key)
        WHERE (a.category, b.category) IN (('composer', 'person'), ('composer', 'ensemble'), ('person', 'ensemble'))
      UNION ALL SELECT CASE WHEN n.canonical = f.owner THEN 'warning' ELSE 'error' END, 'work', n.label, CASE WHEN n.canonical = f.owner THEN 'alias_repeated' ELSE 'alias_used' END,
        CASE WHEN n.canonical = f.owner THEN n.name ELSE n.name || ' <- ' || f.owner END FROM wnames n JOIN wfirst f USING (composer, key) WHERE n.ord * 10 + n.seq > f.pos"""
    # Entries of the user's dictionary by key; the first one of a key is compared.
    ck = K("canonical")
    merge = f"""
      , u AS (SELECT {ck} AS key, min_by(canonical, ord) AS canonical, min_by(aliases, ord) AS aliases FROM ucomp GROUP BY 1),
      b AS (SELECT *, {ck} AS key FROM comp), up AS (SELECT {ck} AS key FROM pers WHERE ord % 3 <> 0),
      ue AS (SELECT entity_id, min(ord) AS ord FROM ens WHERE ord % 3 <> 0 GROUP BY 1)
      SELECT 'add_composer' AS kind, 'composer' AS category, b.canonical AS target, '' AS detail FROM b WHERE key NOT IN (SELECT key FROM u)
      UNION ALL SELECT 'add_person', 'person', canonical, '' FROM pers WHERE {ck} NOT IN (SELECT key FROM up)
      UNION ALL SELECT 'add_ensemble', 'ensemble', entity_id, '' FROM ens WHERE entity_id NOT IN (SELECT entity_id FROM ue) 
      UNION ALL SELECT 'add_alias', 'composer', canonical, name FROM (SELECT u.canonical, u.aliases AS ua, unnest(b.aliases) AS name FROM b JOIN u USING (key))
        WHERE {K("name")} <> {ck} AND NOT list_contains(list_transform(ua, lambda a: {K("a")}), {K("name")})
      UNION ALL SELECT 'add_alias', 'ensemble', e.entity_id, name FROM (SELECT x.entity_id, x.ord AS bo, ue.ord AS uo, unnest([x.canonical, x.era_a, x.era_b]) AS name FROM ens x JOIN ue USING (entity_id)) e
        JOIN ens m ON m.ord = e.uo WHERE name IS NOT NULL AND name NOT IN (coalesce(m.canonical, ''), coalesce(m.era_a, ''), coalesce(m.era_b, ''))
      UNION ALL SELECT 'enable_no_conductor', 'ensemble', e.entity_id, '' FROM ens e JOIN ue USING (entity_id) WHERE e.no_cond
      UNION ALL SELECT 'enable_no_era_split', 'ensemble', e.entity_id, '' FROM ens e JOIN ue USING (entity_id) JOIN ens m ON m.ord = ue.ord WHERE e.no_split AND NOT m.no_split
      UNION ALL SELECT 'add_typo', 'typo', pattern, replacement FROM typ WHERE pattern NOT IN (SELECT pattern FROM typ WHERE ord % 3 <> 0)
      UNION ALL SELECT 'add_protected', 'protected', value, '' FROM prot WHERE {K("value")} NOT IN (SELECT {K("value")} FROM prot WHERE ord % 3 <> 0)"""
    redundant = """SELECT n.category, n.owner, n.source, n.name, f.name AS kept_name FROM named n
      JOIN (SELECT category, ord, key, min(seq) AS seq, min_by(name, seq) AS name FROM named WHERE key <> '' GROUP BY 1, 2, 3) f USING (category, ord, key)
      WHERE n.source = 'alias' AND n.seq > f.seq AND NOT (n.category = 'composer' AND NOT contains(n.name, ' ') AND contains(f.name, ' '))
      UNION ALL SELECT 'work', composer || ': ' || CASE WHEN canonical = '' THEN '(blank)' ELSE canonical END, 'alias', name, kept FROM (
        SELECT n.composer, n.canonical, n.name, n.seq, f.seq AS fs, f.name AS kept FROM (
          SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key FROM (SELECT ord, composer, canonical, unnest(list_concat([canonical], aliases)) AS name, unnest([0, 1, 2]) AS seq FROM wrk)) n
        JOIN (SELECT ord, key, min(seq) AS seq, min_by(name, seq) AS name FROM (
          SELECT ord, seq, name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key FROM (SELECT ord, unnest(list_concat([canonical], aliases)) AS name, unnest([0, 1, 2]) AS seq FROM wrk)) WHERE key <> '' GROUP BY 1, 2) f
        USING (ord, key)) WHERE seq > fs"""
    known = f"""
      , un AS (SELECT category, min_by(owner, ord * 10 + seq) AS owner, key FROM (
          SELECT 'composer' AS category, ord, canonical AS owner, unnest(range(0, 4)) AS seq, {K("name")} AS key FROM (SELECT ord, canonical, unnest(list_concat([canonical], aliases)) AS name FROM ucomp)
          UNION ALL SELECT 'person', ord, canonical, 0, {K("name")} FROM (SELECT ord, canonical, unnest(list_concat([canonical], aliases)) AS name FROM pers WHERE ord % 3 <> 0)) GROUP BY category, key),
      q AS (SELECT DISTINCT unnest(list_concat([canonical], aliases)) AS value FROM comp)
      SELECT value, coalesce(c.category, p.category) AS known_category, coalesce(c.owner, p.owner) AS known_owner FROM q
      LEFT JOIN un c ON c.category = 'composer' AND c.key = {K("value")} LEFT JOIN un p ON p.category = 'person' AND p.key = {K("value")}"""
    suggest = f"""
      , ent AS (SELECT canonical, min_by(aliases, ord) AS aliases FROM comp GROUP BY 1),
      nm AS (SELECT canonical, name, pos, {K("name")} AS key FROM (SELECT canonical, unnest(list_concat([canonical], aliases)) AS name, unnest([0, 1, 2, 3]) AS pos FROM ent)),
      q AS (SELECT DISTINCT unnest([a, substr(a, 1, 7), substr(a, 4, 6)]) AS query FROM (SELECT unnest(aliases) AS a FROM ucomp)),
      hit AS (SELECT query, canonical, name, pos, CASE WHEN starts_with(key, {K("query")}) THEN 0 ELSE 2 END + CASE WHEN name = canonical THEN 0 ELSE 1 END AS rank FROM q JOIN nm ON contains(key, {K("query")})),
      best AS (SELECT query, canonical, min(rank) AS rank, min_by(name, rank * 10 + pos) AS name FROM hit GROUP BY 1, 2)
      SELECT * FROM (SELECT query, canonical, rank, CASE WHEN name <> canonical THEN name END AS matched_alias, row_number() OVER (PARTITION BY query ORDER BY rank, canonical) AS place FROM best) WHERE place <= 20"""
    letter = "substr('abcdefghijklmnopqrstuvwxyz', CAST({} % 26 AS INTEGER) + 1, 1)"
    ids = f"""
      , nm AS (SELECT k AS ord, CASE WHEN k % 3 = 0 THEN '!!' ELSE 'Group: ' || {letter.format('k')} END AS canonical, CASE WHEN k % 3 = 0 THEN 'ensemble' ELSE 'group-' || {letter.format('k')} END AS stem FROM prt),
      old AS (SELECT DISTINCT CASE WHEN k = 1 THEN 'ensemble' WHEN k % 2 = 0 THEN 'ensemble-' || (k * 7) ELSE 'group-' || {letter.format('k')} || '-' || (k % 10) END AS id FROM supp),
      per AS (SELECT stem, count(*) + (SELECT count(*) FROM old) + 1 AS most FROM nm GROUP BY 1),
      free AS (SELECT stem, id, row_number() OVER (PARTITION BY stem ORDER BY n) AS r FROM (
        SELECT stem, n, CASE WHEN n = 1 THEN stem ELSE stem || '-' || n END AS id FROM (SELECT stem, unnest(range(1, most + 1)) AS n FROM per)) WHERE id NOT IN (SELECT id FROM old)),
      asked AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY ord) AS r FROM nm)
      SELECT ord, canonical, id AS entity_id FROM asked JOIN free USING (stem, r)"""
    decided = f"""
      , cat AS (SELECT k, CASE k % 3 WHEN 0 THEN 'composer' WHEN 1 THEN 'person' ELSE 'ensemble' END AS category FROM cust),
      unk AS (SELECT DISTINCT 'Va ' || (k % 800) AS value, category FROM cat),
      dec AS (SELECT k AS seq, 'Va ' || (k % 900) AS value, category, CASE WHEN k % 5 = 0 THEN 'new' WHEN k % 25 = 1 THEN NULL ELSE 'alias' END AS action,
        CASE WHEN k % 7 = 0 THEN ' ' WHEN k % 11 = 0 THEN 'Nobody' WHEN k % 3 = 0 THEN {_CA} WHEN k % 3 = 1 THEN 'Pe ' || {_md5('k % 120')} ELSE 'En ' || {_md5('k % 2000')} END AS target,
        CASE WHEN k % 13 = 0 THEN ' ' ELSE 'New ' || (k % 400) END AS canonical, CASE WHEN k % 17 = 0 THEN NULL ELSE 'n' || (k % 300) END AS entity_id, k % 4 <> 0 AS has_role FROM cat),
      chk AS (SELECT dec.*, CASE WHEN unk.value IS NULL THEN 'not_found' WHEN action = 'alias' AND target = ' ' THEN 'no_target' WHEN action = 'new' AND canonical = ' ' THEN 'no_name'
        WHEN action = 'new' AND dec.category = 'ensemble' AND entity_id IS NULL THEN 'no_entity_id' WHEN action = 'new' AND dec.category = 'person' AND NOT has_role THEN 'no_role'
        WHEN action IS NULL THEN 'no_action' END AS problem FROM dec LEFT JOIN unk ON unk.value = dec.value AND unk.category = dec.category),
      own AS (SELECT 'composer' AS category, canonical AS target, min(ord) AS ord FROM comp GROUP BY 2 UNION ALL SELECT 'person', canonical, min(ord) FROM pers GROUP BY 2
        UNION ALL SELECT 'ensemble', canonical, min(ord) FROM ens WHERE canonical IS NOT NULL GROUP BY 2),
      al AS (SELECT chk.*, own.ord, min(seq) OVER (PARTITION BY chk.category, own.ord, {K('value')}) AS first FROM chk LEFT JOIN own ON own.category = chk.category AND own.target = chk.target WHERE problem IS NULL AND action = 'alias'),
      nw AS (SELECT *, min(seq) OVER (PARTITION BY category, CASE WHEN category = 'ensemble' THEN entity_id ELSE canonical END) AS first FROM chk WHERE problem IS NULL AND action = 'new'),
      outc AS (SELECT seq, value, category, action, problem AS code, ord, canonical FROM (SELECT *, CAST(NULL AS BIGINT) AS ord FROM chk) WHERE problem IS NOT NULL
        UNION ALL SELECT seq, value, category, action, CASE WHEN ord IS NULL THEN 'unknown_target' WHEN seq > first THEN 'claimed' END, ord, canonical FROM al
        UNION ALL SELECT seq, value, category, action, CASE WHEN seq > first THEN 'claimed' END, NULL, canonical FROM nw)"""
    entries = " UNION ALL ".join(
        f"SELECT '{c}' AS category, x.canonical, array_to_string(list_concat(x.aliases, coalesce((SELECT list(o.value ORDER BY o.seq) FROM outc o WHERE o.category = '{c}' AND o.action = 'alias' AND o.code IS NULL AND o.ord = x.ord), [])), '; ') AS aliases FROM {t} x"
        f" UNION ALL SELECT '{c}', canonical, value FROM outc WHERE category = '{c}' AND action = 'new' AND code IS NULL"
        for c, t in (("composer", "comp"), ("person", "pers"))
    )
    return {
        "listing": """SELECT relative_path, CASE k % 7 WHEN 1 THEN 'M4a' WHEN 3 THEN 'Id3' WHEN 6 THEN 'Id3' ELSE 'Flac' END AS format FROM (
          SELECT k, CASE k % 7 WHEN 0 THEN 'a/_New/' WHEN 1 THEN 'a/.h' WHEN 3 THEN '_' WHEN 5 THEN 'b/c/d e/' ELSE '' END || k ||
            CASE k % 7 WHEN 1 THEN '.m4a' WHEN 3 THEN '.mp3' WHEN 5 THEN '.FLAC' WHEN 6 THEN '.aiff' ELSE '.flac' END AS relative_path FROM supp WHERE k % 7 NOT IN (2, 4))""",
        "entity_ids": ids,
        "register_names": decided + " SELECT seq, value, category, action, code FROM outc",
        "registered_entries": decided + " " + entries,
        "dict_issues": issues + clash,
        "dict_merge_plan": merge,
        "dict_merge_apply": f"""SELECT list, entries, 2 AS version FROM (
          SELECT 'composers' AS list, (SELECT count(*) FROM ucomp) + count_if({ck} NOT IN (SELECT {ck} FROM ucomp)) AS entries FROM comp
          UNION ALL SELECT 'persons', count_if(ord % 3 <> 0) + count_if({ck} NOT IN (SELECT {ck} FROM pers WHERE ord % 3 <> 0)) FROM pers
          UNION ALL SELECT 'ensembles', count_if(ord % 3 <> 0) + count_if(entity_id NOT IN (SELECT entity_id FROM ens WHERE ord % 3 <> 0)) FROM ens
          UNION ALL SELECT 'works', count(*) FROM wrk UNION ALL SELECT 'overrides', count(*) FROM ovr
          UNION ALL SELECT 'typos', count(*) FROM typ
          UNION ALL SELECT 'protected', count_if(ord % 3 <> 0) + count_if({K("value")} NOT IN (SELECT {K("value")} FROM prot WHERE ord % 3 <> 0)) FROM prot)""",
        "redundant_aliases": redundant,
        "canonical_names": "SELECT DISTINCT category, name FROM named WHERE source IN ('canonical', 'era')",
        "already_known": known,
        "suggest_names": suggest,
    }
