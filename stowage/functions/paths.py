"""Remote paths and name safety as native Column expressions.

A remote path is STRUCT<segments ARRAY<STRING>, is_collection BOOLEAN>; segments are decoded.
Everything stays on the JVM. Clean names take a branch made of code-generated string functions
only; the array functions run just for the rare names that need them.
"""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, functions as F

from stowage.schema import MAX_SEGMENT_LENGTH

# Rejection reasons.
NONE, EMPTY, TRAVERSAL = "None", "Empty", "Traversal"
SEMICOLON, ILLEGAL, TOO_LONG = "SemicolonTruncatesOnServer", "IllegalCharacter", "TooLong"
OUTSIDE_BASE = "OutsideBase"

_ILLEGAL = r'[/\\:*?"<>|]'
_CONTROL = r"[\x{00}-\x{1F}\x{7F}-\x{9F}]"
# A path free of all this needs neither decoding nor the rule-by-rule check: no special character,
# and no segment that is empty, long, or starts with a dot or a space of any kind.
_SPACES = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SUSPECT = (r'[;:*?"<>|%\x{00}-\x{1F}\x{7F}-\x{9F}]|^[./' + _SPACES + r"]|/[./" + _SPACES + r"]|/$|[^/]{128}")
# One escape of ASCII, one well-formed UTF-8 escape sequence, or text that is not an escape.
_ESCAPES = (
    "%[0-7][0-9A-Fa-f]"
    "|%[CDcd][0-9A-Fa-f]%[89ABab][0-9A-Fa-f]"
    "|%[Ee][0-9A-Fa-f](%[89ABab][0-9A-Fa-f]){2}"
    "|%[Ff][0-4](%[89ABab][0-9A-Fa-f]){3}"
    "|[^%]+|%"
)
_REPLACEMENT = "�"


def path_key(path: Column) -> Column:
    """The case-folded join key of a local path."""
    return F.lower(path)


def file_name(path: Column) -> Column:
    """The part after the last slash of either kind."""
    return F.substring_index(_slashed(path), "/", -1)


def extension(name: Column) -> Column:
    """From the last dot, lower-cased; empty without one or when the dot ends the name."""
    last = F.substring_index(name, ".", -1)
    return F.when(name.contains(".") & (last != ""), F.lower(F.concat(F.lit("."), last))
                  ).otherwise("")


def _let(value: Column, body) -> Column:
    """Evaluates ``value`` once for all its uses in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _slashed(text: Column) -> Column:
    return F.replace(text, F.lit("\\"), F.lit("/"))


def percent_decode(text: Column) -> Column:
    """Decodes the valid percent escapes and leaves every other character alone."""

    def decode(token: Column) -> Column:
        plain = F.try_url_decode(token)
        broken = plain.contains(_REPLACEMENT) & (F.upper(token) != "%EF%BF%BD")
        is_escape = token.startswith("%") & (F.length(token) >= 3)
        return F.when(is_escape & ~broken, plain).otherwise(token)

    tokens = F.regexp_extract_all(text, F.lit(_ESCAPES), F.lit(0))
    return F.when(text.contains("%"), F.array_join(F.transform(tokens, decode), "")).otherwise(text)


def encode_segment(segment: Column) -> Column:
    """Percent-encodes all but letters, digits and ``- . _ ~ @``."""
    form = F.url_encode(segment)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%40", "@")):
        form = F.replace(form, F.lit(found), F.lit(wanted))
    return form


def _split(text: Column) -> Column:
    return F.filter(F.split(_slashed(text), "/"), lambda s: s != "")


def parse_remote_path(text: Column) -> Column:
    """STRUCT<segments, is_collection, error>; the error is set when a segment is ``..``."""
    normal = _slashed(text)
    decoded = F.transform(_split(text), percent_decode)
    kept = F.filter(decoded, lambda s: (s != "") & (s != "."))
    error = F.when(
        F.array_contains(decoded, ".."),
        F.concat(F.lit("Path segment '..' is not allowed in a remote path: '"), text, F.lit("'.")))
    return F.struct(
        F.when(error.isNull(), kept).alias("segments"),
        ((normal == "") | normal.endswith("/") | (F.size(kept) == 0)).alias("is_collection"),
        error.alias("error"))


def from_segments(segments: Column, is_collection: bool = False) -> Column:
    """Builds a path from decoded segments; an unusable segment makes the error non-null."""
    kept = F.filter(segments, lambda s: s.isNotNull() & (s != "") & (s != "."))
    bad = F.filter(kept, lambda s: (s == "..") | s.rlike(r"[/\\]"))
    error = F.when(F.size(bad) > 0, F.concat(
        F.lit("Invalid remote path segment: '"), F.try_element_at(bad, F.lit(1)), F.lit("'.")))
    return F.struct(
        F.when(error.isNull(), kept).alias("segments"),
        (F.lit(is_collection) | (F.size(kept) == 0)).alias("is_collection"),
        error.alias("error"))


def append_path(path: Column, segment: Column, is_collection: bool = False) -> Column:
    """Appends one decoded segment; ``.``, ``..``, slashes and empty names are refused."""
    bad = segment.isNull() | segment.isin("", ".", "..") | segment.rlike(r"[/\\]")
    error = F.when(bad, F.concat(
        F.lit("Invalid remote path segment: '"), F.coalesce(segment, F.lit("")), F.lit("'.")))
    return F.struct(
        F.when(~bad, F.concat(path["segments"], F.array(segment))).alias("segments"),
        F.lit(is_collection).alias("is_collection"),
        error.alias("error"))


def append_relative(path: Column, relative: Column) -> Column:
    """Appends a parsed relative path and takes over its collection flag."""
    empty = F.size(relative["segments"]) == 0
    return F.struct(
        F.concat(path["segments"], relative["segments"]).alias("segments"),
        F.when(empty, path["is_collection"]).otherwise(relative["is_collection"])
        .alias("is_collection"))


def encode_path(path: Column) -> Column:
    """``/a/b`` with encoded segments, ``/a/b/`` for a collection, ``/`` for the root."""
    body = F.concat(F.lit("/"), F.array_join(F.transform(path["segments"], encode_segment), "/"))
    closed = F.when(path["is_collection"], F.concat(body, F.lit("/"))).otherwise(body)
    return F.when(F.size(path["segments"]) == 0, F.lit("/")).otherwise(closed)


def path_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(path["segments"], F.lit(-1)), F.lit(""))


def path_parent(path: Column) -> Column:
    """The containing collection; the root is its own parent."""
    count = F.size(path["segments"])
    return F.struct(
        F.slice(path["segments"], F.lit(1), F.greatest(count - 1, F.lit(0))).alias("segments"),
        F.lit(True).alias("is_collection"))


def as_collection(path: Column, is_collection: bool = True) -> Column:
    return F.struct(path["segments"].alias("segments"), F.lit(is_collection).alias("is_collection"))


def is_under(path: Column, ancestor: Column) -> Column:
    """True for the ancestor itself and all below it, segment by segment, case-sensitive."""
    head = F.slice(path["segments"], F.lit(1), F.size(ancestor["segments"]))
    return head == ancestor["segments"]


def to_uri(path: Column, server: Column) -> Column:
    """Authority and base path of the server, then the encoded path."""
    base_path = F.regexp_replace(F.coalesce(F.parse_url(server, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.concat(
        F.lower(F.parse_url(server, F.lit("PROTOCOL"))), F.lit("://"),
        F.parse_url(server, F.lit("AUTHORITY")), base_path, encode_path(path))


def _verdict(reason: str, message: Column | None) -> Column:
    text = F.lit(None).cast("string") if message is None else message
    return F.struct(F.lit(reason).alias("reason"), text.alias("message"))


def validate_segment(segment: Column) -> Column:
    """STRUCT<reason, message>; the first rule that fails decides."""
    # The sentences are shown to the user.
    quoted = F.concat(F.lit("'"), segment, F.lit("'"))
    # UTF-16 units, not code points.
    units = (F.length(F.encode(segment, "UTF-16BE")) / 2).cast("int")
    return (
        F.when(segment.isNull() | segment.rlike(r"(?U)^\s*$"),
               _verdict(EMPTY, F.lit("The name is empty.")))
        .when(segment.isin(".", ".."), _verdict(TRAVERSAL, F.concat(
            quoted, F.lit(" is a relative path segment and cannot be used as a name."))))
        .when(segment.contains(";"), _verdict(SEMICOLON, F.concat(
            quoted, F.lit(" contains a semicolon. The server truncates the name at the first "
                          "semicolon, so this would be stored as '"),
            F.substring_index(segment, ";", 1),
            F.lit("' and could silently overwrite another file. Rename it before uploading."))))
        .when(units > MAX_SEGMENT_LENGTH, _verdict(TOO_LONG, F.concat(
            F.lit("The name is "), units.cast("string"),
            F.lit(f" characters; the limit is {MAX_SEGMENT_LENGTH}."))))
        .when(segment.rlike(_ILLEGAL), _verdict(ILLEGAL, F.concat(
            quoted, F.lit(" contains '"), F.regexp_extract(segment, _ILLEGAL, 0),
            F.lit("', which cannot be used in a remote name."))))
        .when(segment.rlike(_CONTROL), _verdict(ILLEGAL, F.lit(
            "The name contains a control character.")))
        .otherwise(_verdict(NONE, None)))


def validate_relative_path(text: Column) -> Column:
    """The verdict on the first bad segment."""

    def judge(verdicts: Column) -> Column:
        bad = F.filter(verdicts, lambda v: v["reason"] != NONE)
        return F.when(F.size(verdicts) == 0, _verdict(EMPTY, F.lit("The path is empty."))
                      ).otherwise(F.coalesce(F.try_element_at(bad, F.lit(1)), _verdict(NONE, None)))

    return _let(F.transform(_split(text), validate_segment), judge)


def relative_path(path: Column, base: str) -> Column:
    """The path below ``base`` in any case, with forward slashes; NULL when it lies outside."""
    root = base.replace("\\", "/").rstrip("/")
    normal = _slashed(path)
    # Only the prefix is folded.
    inside = F.lower(F.substr(normal, F.lit(1), F.lit(len(root) + 1))) == root.lower() + "/"
    below = F.substr(normal, F.lit(len(root) + 2))
    itself = F.lower(F.rtrim(normal, F.lit("/"))) == root.lower()
    return (F.when(inside & (below != "") & ~below.startswith(".."), below)
            .when(itself, F.lit(".")))


def root_segments(dest_root: str) -> list[str]:
    """Decoded segments of a destination root given as an argument."""
    parts = [unquote(p) for p in dest_root.replace("\\", "/").split("/") if p]
    if ".." in parts:
        raise ValueError(f"Path segment '..' is not allowed in a remote path: '{dest_root}'.")
    return [p for p in parts if p not in ("", ".")]


def encoded_root(dest_root: str) -> str:
    parts = root_segments(dest_root)
    return "/" + "".join(quote(p, safe="-._~@") + "/" for p in parts)


def with_destination(df: DataFrame, base: str, dest_root: str, path: str = "path",
                     resolved_only: bool = False) -> DataFrame:
    """Adds destination, folder, name, reason and message for every local path.

    ``destination`` and ``folder`` are encoded, ``name`` is decoded. Where the file has no safe
    destination those three are NULL and reason and message say why; ``resolved_only`` leaves
    such files out. It does so with a generator, because a filter on the result would be pushed
    below it and work everything out a second time.
    """
    root = root_segments(dest_root)
    prefix = encoded_root(dest_root)
    rel = F.col("_rel")
    suspect = rel.rlike(_SUSPECT)

    nothing = F.lit(None).cast("string")

    def refused(reason: Column, message: Column) -> Column:
        return F.struct(reason.alias("reason"), message.alias("message"),
                        nothing.alias("destination"), nothing.alias("folder"),
                        nothing.alias("name"))

    def placed(parsed: Column) -> Column:
        target = F.struct(
            F.concat(F.array(*[F.lit(s) for s in root]).cast("array<string>"),
                     parsed["segments"]).alias("segments"),
            F.lit(False).alias("is_collection"))
        return F.when(parsed["error"].isNotNull(), refused(F.lit(TRAVERSAL), parsed["error"])
                      ).otherwise(F.struct(
                          F.lit(NONE).alias("reason"), nothing.alias("message"),
                          encode_path(target).alias("destination"),
                          encode_path(path_parent(target)).alias("folder"),
                          path_name(target).alias("name")))

    checked = _let(validate_relative_path(rel), lambda v: F.when(
        v["reason"] != NONE, refused(v["reason"], v["message"])
    ).otherwise(_let(parse_remote_path(rel), placed)))

    simple = F.concat(F.lit(prefix), F.replace(encode_segment(rel), F.lit("%2F"), F.lit("/")))
    direct = F.struct(
        F.lit(NONE).alias("reason"), nothing.alias("message"),
        F.col("_simple").alias("destination"),
        F.concat(F.lit(prefix), _parent_text(F.col("_simple"), len(prefix))).alias("folder"),
        file_name(rel).alias("name"))
    outside = refused(F.lit(OUTSIDE_BASE), F.concat(
        F.lit("'"), F.col(path), F.lit(f"' is not inside '{base}'.")))
    place = (F.when(F.col("_simple").isNotNull(), direct).when(rel.isNull(), outside)
             .otherwise(checked))

    kept = [c for c in df.columns if c not in ("destination", "folder", "name", "reason", "message")]
    fields = ("destination", "folder", "name", "reason", "message")
    staged = (df.withColumn("_rel", relative_path(F.col(path), base))
              .withColumn("_simple", F.when(~suspect, simple)))
    if resolved_only:
        one = F.filter(F.array(place), lambda p: p["reason"] == NONE)
        staged = staged.select(*kept, F.explode(one).alias("_place"))
    else:
        staged = staged.withColumn("_place", place)
    return staged.select(*kept, *[F.col(f"_place.{f}").alias(f) for f in fields])


def _parent_text(encoded: Column, skip: int) -> Column:
    """The folders between the root and the name, each closed by a slash."""
    below = F.substr(encoded, F.lit(skip + 1))
    last = F.length(F.substring_index(below, "/", -1))
    return F.substr(below, F.lit(1), F.length(below) - last)


def destination_of(rel: Column, dest_root: str) -> Column:
    """The encoded destination of a relative path, or NULL where it has none."""
    suspect = rel.rlike(_SUSPECT)
    simple = F.concat(F.lit(encoded_root(dest_root)),
                      F.replace(encode_segment(rel), F.lit("%2F"), F.lit("/")))
    root = F.array(*[F.lit(s) for s in root_segments(dest_root)]).cast("array<string>")

    def placed(parsed: Column) -> Column:
        return F.when(parsed["error"].isNull(), encode_path(F.struct(
            F.concat(root, parsed["segments"]).alias("segments"),
            F.lit(False).alias("is_collection"))))

    checked = _let(validate_relative_path(rel), lambda v: F.when(
        v["reason"] == NONE, _let(parse_remote_path(rel), placed)))
    return F.when(rel.isNull(), F.lit(None).cast("string")).when(~suspect, simple).otherwise(checked)


def resolve_destination(path: Column, base: str, dest_root: str) -> Column:
    """The encoded destination of a local path, or NULL where it has none."""
    return destination_of(relative_path(path, base), dest_root)


def stored_name(segments: Column) -> Column:
    """What the server keeps: every segment cut at its first semicolon."""
    return F.transform(segments, lambda s: F.substring_index(s, ";", 1))


def normalise_extensions(text: Column) -> Column:
    """``raw, .WIFF;mzml`` to distinct lower-case extensions with a leading dot."""
    parts = F.filter(F.split(text, "[,; ]"), lambda s: F.trim(s) != "")
    return F.array_distinct(F.transform(
        parts, lambda s: F.lower(F.when(F.trim(s).startswith("."), F.trim(s))
                                 .otherwise(F.concat(F.lit("."), F.trim(s))))))


def map_drive_path(path: Column, share: Column) -> Column:
    """Puts ``share`` in place of the drive letter; a NULL share leaves the path alone."""
    rest = F.regexp_replace(F.substr(path, F.lit(3)), r"^[\\/]+", "")
    mapped = F.when(rest == "", share).otherwise(
        F.concat(F.regexp_replace(share, r"\\+$", ""), F.lit("\\"), rest))
    return F.when(share.isNull(), path).otherwise(mapped)
