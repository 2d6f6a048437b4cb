"""Schemas and fixed names of the catalogue tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The canonical fields in their sort order.
FIELDS = [
    "title", "artist", "albumartist", "composer", "conductor", "album",
    "genre", "date", "tracknumber", "discnumber", "comment",
]
FIELD_ORD = {name: i for i, name in enumerate(FIELDS)}
FREE_TEXT_FIELDS = ["comment"]
INSPECTED_FIELDS = [f for f in FIELDS if f not in FREE_TEXT_FIELDS]

# File extensions per format, and fields a format cannot hold.
FORMAT_BY_EXTENSION = {
    ".m4a": "M4a", ".flac": "Flac", ".mp3": "Id3", ".aif": "Id3", ".aiff": "Id3",
}
UNSUPPORTED = {("Id3", "comment")}

# Rule constants.
GENRE = "Classic"
SINGLE_DISC = "1/1"
MANUAL_RULE = "MANUAL"
JOIN = "; "

_texts = T.ArrayType(T.StringType(), False)

TRACK_SCHEMA = T.StructType(
    [
        T.StructField("relative_path", T.StringType(), False),
        T.StructField("full_path", T.StringType()),
        T.StructField("format", T.StringType()),
    ]
    + [T.StructField(f, _texts) for f in FIELDS]
    + [T.StructField("raw_tags", T.MapType(T.StringType(), _texts))]
)

# What a rule emits for one field of one row.
CHANGE_TYPE = (
    "struct<field:string,field_ord:int,before:array<string>,after:array<string>,"
    "rule_id:string,severity:string,hold:string,clears:boolean,evidence:map<string,string>>"
)

CHANGE_COLUMNS = [
    "relative_path", "path_key", "field", "field_ord", "before", "after",
    "rule_id", "severity", "hold", "clears", "evidence", "is_selected",
]

_strings = "array<string>"
DICTIONARY_JSON = (
    "version int,"
    f"composers array<struct<canonical:string,aliases:{_strings},aliasesJa:{_strings}>>,"
    f"persons array<struct<canonical:string,roles:{_strings},aliases:{_strings},aliasesJa:{_strings}>>,"
    "ensembles array<struct<entityId:string,canonical:string,"
    "eras:array<struct<`from`:int,`until`:int,canonical:string>>,"
    f"noEraSplit:boolean,noConductor:boolean,aliases:{_strings},aliasesJa:{_strings}>>,"
    f"works array<struct<composer:string,canonical:string,aliases:{_strings},aliasesJa:{_strings}>>,"
    "albumOverrides array<struct<folder:string,disc:int,composer:string,workName:string,"
    "date:string,exclude:boolean,note:string>>,"
    "typos array<struct<pattern:string,replacement:string,note:string>>,"
    f"protectedAlbumArtists {_strings}"
)
