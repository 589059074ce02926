"""Raw lines to levels, times and messages, and messages to signatures, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels of Apache error logs, and the masks of a signature.
APACHE_LEVELS = {
    "emerg": "CRITICAL", "alert": "CRITICAL", "crit": "CRITICAL", "error": "ERROR", "warn": "WARNING", "notice": "INFO", "info": "INFO", "debug": "DEBUG",
}
HEX, UUID, IP, NUM = "<HEX>", "<UUID>", "<IP>", "<NUM>"

# Levels of text logs, in the order in which a prefix is looked for, and words of system logs.
LEVELS = ("INFO", "ERROR", "WARN", "WARNING", "DEBUG", "CRITICAL", "FATAL")
SYSLOG_LEVELS = ("error", "warning", "fatal")
SYSLOG_FAILURES = ("authentication failure", "failed password")

SPACE = " \t\n\x0b\x0c\r"
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A run of digits that is masked. Kept are up to three digits inside a word, versions such as v2 and HTTP/1.1, and a
#: three-digit code from 1xx to 5xx shortly after "status", "code" or "http".
_DIGITS = (
    r"(?<!\p{Nd})(?!(?<=\p{L})\p{Nd}{1,3}(?=[\p{L}_]))(?!(?<=(?<!\p{L})[vV])\p{Nd}{1,2}(?!\p{Nd}))(?<!(?i:http)/[\p{Nd}.]{0,7})"
    r"(?!(?<=(?:(?i:status)[^a-zA-Z]{0,6}|(?i:code|http)[^a-zA-Z]{0,8}))[1-5]\p{Nd}{2}(?!\p{Nd}))\p{Nd}++"
)


def log_signature(message: Column) -> Column:
    """The message with hex numbers, UUIDs, IPv4 addresses and digit runs masked and white space collapsed."""
    masked = F.regexp_replace(message, r"0x[0-9a-fA-F]+", HEX)
    masked = F.regexp_replace(masked, r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", UUID)
    masked = F.regexp_replace(masked, r"(?U)\b\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\b", IP)
    masked = F.regexp_replace(masked, _DIGITS, NUM)
    return F.trim(F.regexp_replace(masked, r"(?U)\s+", " "))


def parse_timestamp(text: Column, now: Column) -> Column:
    """UTC time of a stamp in any of the known formats, null if it has none.

    Stamps without a zone are UTC. A syslog stamp has no year: it gets that of ``now``, or the one before if that would
    lie more than a day ahead.
    """
    text = F.trim(text)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.regexp_replace(text, ",", ".").try_cast("timestamp"))
    access = F.when(text.rlike(r"^\d{2}/[A-Z][a-z]{2}/\d{4}:"), F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z")))
    squeezed = F.regexp_replace(text, r"\s+", " ")
    apache = F.when(squeezed.rlike(r"^[A-Z][a-z]{2} [A-Z][a-z]{2} \d{1,2} .* \d{4}$"), F.try_to_timestamp(F.substring(squeezed, F.lit(5), F.length(squeezed)), F.lit("MMM d HH:mm:ss yyyy")))
    in_year = lambda year: F.try_to_timestamp(F.concat(squeezed, F.lit(" "), year.cast("string")), F.lit("MMM d HH:mm:ss yyyy"))
    this, last = in_year(F.year(now)), in_year(F.year(now) - 1)
    syslog = F.when(squeezed.rlike(r"^[A-Z][a-z]{2} \d{1,2} \d{2}:\d{2}:\d{2}$"), F.when(this > now + F.expr("interval 1 day"), last).otherwise(F.coalesce(this, last)))
    return F.coalesce(iso, access, apache, syslog)


def _json_text(parsed: Column, *keys: str) -> Column:
    """The first of some keys of a JSON object that is neither missing, null, false, zero nor empty, as text."""
    found = [F.try_variant_get(parsed, f"$['{k}']", "string") for k in keys]
    return F.coalesce(*[F.when(~x.isin("", "false", "0"), x) for x in found])


def _shape(text: Column) -> Column:
    """Digits as 0, capitals as A, small letters as a: what a stamp looks like."""
    return F.translate(text, DIGITS + UPPER + LOWER, "0" * 10 + "A" * 26 + "a" * 26)


def _from(text: Column, at: Column | int) -> Column:
    """The text from a place on, counted from 1."""
    return F.substring(text, F.lit(at) if isinstance(at, int) else at, F.length(text))


def _run(text: Column, kind: str) -> Column:
    """The characters of one kind that a text begins with."""
    return F.left(text, F.length(text) - F.length(F.ltrim(text, F.lit(kind))))


def _iso_length(line: Column) -> Column:
    """How many characters of a line are its ISO stamp: 0, or date and time with a fraction and a zone where there are any."""
    stamp = F.upper(F.left(line, F.lit(19)))
    rest = _from(line, 20)
    digits = F.when(F.left(rest, F.lit(1)).isin(".", ","), F.length(_run(_from(rest, 2), DIGITS))).otherwise(0)
    fraction = F.when(digits > 0, digits + 1).otherwise(0)
    zone = F.upper(_shape(F.substring(rest, fraction + 1, F.lit(6))))
    signed = F.left(zone, F.lit(1)).isin("+", "-")
    after = F.when(signed & (F.substring(zone, 2, 5) == "00:00"), 6).when(signed & (F.substring(zone, 2, 4) == "0000"), 5).when(F.upper(F.substring(rest, fraction + 1, F.lit(1))) == "Z", 1).otherwise(0)
    return F.when(_shape(stamp).isin("0000-00-00 00:00:00", "0000-00-00A00:00:00") & F.substring(stamp, 11, 1).isin(" ", "T"), 19 + fraction + after).otherwise(0)


def parse_log_lines(lines: DataFrame, now: Column, legacy_levels: bool = False) -> DataFrame:
    """``lines`` with ts_str, level, message and ts, by the first format of: JSON object, level text, Apache error, syslog,
    access log, plain text.

    Formats are told by the shapes of a line's parts, taken by position; nothing searches a line by a pattern. A level must
    end before another letter; ``legacy_levels`` reads a prefix of a longer word, so that "[WARNING] x" gives WARN. JSON
    that is no object is plain text.
    """
    # each step is a projection of its own: what it finds is used several times by the next
    steps: list[str] = []

    def step(rows: DataFrame, **columns: Column) -> DataFrame:
        steps.extend(columns)
        return rows.withColumns(columns)

    line = F.col("_line")
    rows = step(lines, _line=F.btrim(F.col("line"), F.lit(SPACE)))
    rows = step(rows, _json=F.try_parse_json(F.when(line.startswith("{"), line)), _stamp=_iso_length(line), _words=F.split(line, r"\s+", 4), _fields=F.split(line, " ", 4))

    # level text: a stamp or none, a dash or none, the level with or without brackets
    rest = F.ltrim(_from(line, F.col("_stamp") + 1), F.lit(SPACE))
    rest = F.when(rest.startswith("-"), F.ltrim(_from(rest, 2), F.lit(SPACE))).otherwise(rest)
    rows = step(rows, _rest=F.when(rest.startswith("["), _from(rest, 2)).otherwise(rest))
    rest, upper = F.col("_rest"), F.upper(F.left(F.col("_rest"), F.lit(9)))
    if legacy_levels:
        level = F.coalesce(*[F.when(upper.startswith(x), x) for x in LEVELS])
    else:
        word = F.upper(_run(F.left(rest, F.lit(9)), UPPER + LOWER))
        level = F.when(word.isin(*LEVELS), word)
    rows = step(rows, _level=level)
    after = _from(rest, F.length("_level") + 1)
    text_message = F.ltrim(F.when(after.startswith("]"), _from(after, 2)).otherwise(after), F.lit(SPACE))

    # Apache error: [stamp] [level] message
    stamp = F.substring_index(_from(line, 2), "]", 1)
    rows = step(rows, _apache=F.when(line.startswith("[") & _shape(stamp).isin(*[f"Aaa Aaa{gap}{day} 00:00:00 0000" for gap in (" ", "  ") for day in ("0", "00")]), stamp))
    tail = _from(line, F.length("_apache") + 2)
    severity = F.substring_index(_from(tail, 4), "]", 1)
    apache_message = _from(tail, F.length(severity) + 6)
    is_apache = F.col("_apache").isNotNull() & tail.startswith("] [") & (severity != "") & (F.ltrim(severity, F.lit(LOWER)) == "") & (F.substring(tail, F.length(severity) + 4, F.lit(2)) == "] ") & (apache_message != "")
    table = F.create_map(*[F.lit(x) for pair in APACHE_LEVELS.items() for x in pair])

    # syslog: month, day, time, the rest; the level may stand after the first ": "
    word = lambda i: F.get("_words", F.lit(i))
    body = word(3)
    is_syslog = (_shape(word(0)) == "Aaa") & _shape(word(1)).isin("0", "00") & (_shape(word(2)) == "00:00:00") & (body != "")
    syslog_stamp = F.rtrim(F.left(line, F.length(line) - F.length(body)), F.lit(SPACE))
    said = F.when(body.contains(": "), _from(body, F.instr(body, ": ") + 2))
    hint = _run(said, UPPER + LOWER)
    syslog_level = (
        F.when(F.lower(hint).isin(*SYSLOG_LEVELS) & F.substring(said, F.length(hint) + 1, F.lit(1)).isin(":", " "), F.upper(hint))
        .when(F.lower(said).contains(SYSLOG_FAILURES[0]) | F.lower(said).contains(SYSLOG_FAILURES[1]), "WARNING").otherwise("INFO")
    )

    # access log: host, two fields, [stamp], message
    field = lambda i: F.get("_fields", F.lit(i))
    solid = lambda x: (x != "") & (F.translate(x, SPACE, "") == x)
    when_ = F.substring_index(_from(field(3), 2), "]", 1)
    asked = _from(field(3), F.length(when_) + 4)
    is_access = (
        solid(field(0)) & solid(field(1)) & solid(field(2)) & field(3).startswith("[") & _shape(when_).isin("00/Aaa/0000:00:00:00 +0000", "00/Aaa/0000:00:00:00 -0000")
        & (F.substring(field(3), F.length(when_) + 2, F.lit(2)) == "] ") & (asked != "")
    )

    is_json = F.coalesce(F.schema_of_variant("_json").startswith("OBJECT"), F.lit(False))
    formats = [
        (is_json, _json_text(F.col("_json"), "timestamp", "time", "@timestamp"), F.upper(F.coalesce(_json_text(F.col("_json"), "level", "log_level"), F.lit("INFO"))), F.coalesce(_json_text(F.col("_json"), "message", "msg"), line)),
        (F.col("_level").isNotNull(), F.nullif(F.left(line, F.col("_stamp")), F.lit("")), F.col("_level"), text_message),
        (is_apache, F.col("_apache"), F.coalesce(F.try_element_at(table, severity), F.lit("INFO")), apache_message),
        (is_syslog, syslog_stamp, syslog_level, body),
        (is_access, when_, F.lit("INFO"), F.concat(field(0), F.lit(" "), asked)),
        (F.lit(True), F.lit(None).cast("string"), F.lit("INFO"), line),
    ]
    number = F.coalesce(*[F.when(found, F.lit(i)) for i, (found, *_) in enumerate(formats)])
    rows = step(rows, _format=number)

    def pick(i: int) -> Column:
        return F.coalesce(*[F.when(F.col("_format") == k, parts[i]) for k, parts in enumerate(formats)])

    # An array of one row: conditions on what is read stay above it. Pushed below, they would repeat all steps many times over.
    read = F.struct(pick(1).alias("ts_str"), pick(2).alias("level"), pick(3).alias("message"))
    names = [c for c in lines.columns if c.lower() not in ("ts_str", "level", "message")]
    rows = rows.select(*names, F.explode(F.array(read)).alias("_read")).select(*names, "_read.*")
    return rows.withColumn("ts", parse_timestamp(F.col("ts_str"), now))


def chunk_text(signature: Column, examples: Column) -> Column:
    return F.concat(F.lit("Signature: "), signature, F.lit("\nExamples: "), F.array_join(examples, " "))


def extract_signature(text: Column) -> Column:
    """The signature in a chunk's text, '' if it does not open with one."""
    body = F.split_part(F.split_part(text, F.lit("Signature: "), F.lit(2)), F.lit("\nExamples:"), F.lit(1))
    return F.when(text.startswith("Signature: "), F.trim(body)).otherwise("")


def backfill_signature(chunks: DataFrame) -> DataFrame:
    """Chunks without a signature get that of their text, if it has one."""
    return chunks.withColumn("signature", F.coalesce("signature", F.nullif(extract_signature(F.col("text")), F.lit(""))))
