"""Secret scans with multipart credential linking, with DataFrame functions only.

Every text is split by a pattern and matched by the same pattern; the code
points of the pieces and of the matches, summed up in order, give the spans.
Only lengths leave the scan, and only of texts that a cheap test lets through.

Base kinds, each leftmost and non-overlapping; failing matches are dropped:

* assign: a credential word, `:` or `=`, and a value of 12 or more characters,
* access: an access key id of 18 or more characters,
* hex: a run of 16 or more lower-case hex digits.

Weak parts are reported only with their complement, another span beside the
part: spans that overlap it never vouch for it. Scopes are the REACH code
points on both sides of a part:

* weak (secret): an assignment whose value is shorter, or a run of 20 or more
  base64 characters with upper and lower case and a digit, when an identifier
  or an endpoint stands within its scope,
* user (identifier): an assigned user, account or client name, when a secret
  stands within its scope,
* endpoint: a URL or a host assignment, when both a secret and an identifier do.

The interval join runs over the ends of the spans in order: before a span's
start the last stop of each class, after its stop the next start. One sorted
pass a document each way, and no list of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points between a weak part and its complement at most.
REACH = 160

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
BLOB = r"[A-Za-z0-9+/]{20,}"
USER = r"""(?i:(user|username|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
ENDPOINT = r"""(?i:(https?|ftp|ssh|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9_.@:/-]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.-]+)"""

#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "weak", "user", "endpoint")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    test = low.contains(words[0])
    for w in words[1:]:
        test = test | low.contains(w)
    return test


def _scan(text: Column, pattern: str, possible: Column, value: int = 0) -> Column:
    """array<struct<i, gap, n, ok>>: for each match the code points between it and the one before, its own and, of the value group, their number."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(value)).alias("value"),
    )
    rows = F.transform(
        parts,
        lambda p, i: F.struct(
            i.alias("i"),
            F.char_length(p["gap"]).alias("gap"),
            F.char_length(p["hit"]).alias("n"),
            F.char_length(p["value"]).alias("value"),
            (p["value"].rlike("[A-Z]") & p["value"].rlike("[a-z]") & p["value"].rlike("[0-9]")).alias("mixed"),
        ),
    )
    return F.when(possible, F.filter(rows, lambda r: r["n"].isNotNull()))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, kind, start, stop) of all base spans and all linked weak parts; stop is exclusive.

    Rows with one doc_id and text are scanned once. A null text is empty; a
    null doc_id stays null. Of weak parts, those that overlap a base span are
    that span and are not reported again.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    x = F.col("text")
    scans = {
        "assign": _scan(x, ASSIGN, _any(x, ("passw", "secret", "token", "apikey", "api_key")), 2),
        "access": _scan(x, ACCESS, x.contains("AKIA")),
        "hex": _scan(x, HEX, x.rlike(HEX)),
        "blob": _scan(x, BLOB, x.rlike(BLOB)),
        "user": _scan(x, USER, _any(x, ("user", "login", "account", "client", "access"))),
        "endpoint": _scan(x, ENDPOINT, _any(x, ("://", "host", "endpoint", "server"))),
    }
    found = docs.select("doc_id", "text_hash", *(c.alias(k) for k, c in scans.items()))
    found = found.where(" or ".join(f"size({k}) > 0" for k in scans))
    found = found.dropDuplicates(["doc_id", "text_hash"])
    one = F.array(*(F.struct(F.lit(k).alias("scan"), F.coalesce(F.col(k), F.array().cast("array<struct<i:int,gap:int,n:int,value:int,mixed:boolean>>")).alias("hits")) for k in scans))
    found = found.select("doc_id", "text_hash", F.explode(one).alias("s"))
    found = found.select("doc_id", "text_hash", "s.scan", F.explode("s.hits").alias("h")).select("doc_id", "text_hash", "scan", "h.*")

    doc = ["doc_id", "text_hash"]
    upto = Window.partitionBy(*doc, "scan").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("stop", F.sum(F.col("gap").cast("long") + F.col("n")).over(upto)).withColumn("start", F.col("stop") - F.col("n"))
    kind = (
        F.when(F.col("scan") == "assign", F.when(F.col("value") >= 12, "assign").otherwise("weak"))
        .when(F.col("scan") == "blob", F.when(F.col("mixed"), "weak"))
        .otherwise(F.col("scan"))
    )
    found = found.select(*doc, kind.alias("kind"), "start", "stop").where("kind is not null").distinct()

    order = Window.partitionBy(*doc).orderBy("start", "stop", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    is_base = F.col("kind").isin("assign", "access", "hex")
    overlapped = F.coalesce(F.max(F.when(is_base, F.col("stop"))).over(before) > F.col("start"), F.lit(False))
    overlaps = F.coalesce(F.min(F.when(is_base, F.col("start"))).over(after) < F.col("stop"), F.lit(False))
    found = found.withColumn("covered", overlapped | overlaps)

    ends = F.array(F.struct(F.lit(1).alias("opens"), F.col("start").alias("at")), F.struct(F.lit(0).alias("opens"), F.col("stop").alias("at")))
    found = found.withColumn("end", F.explode(ends)).select(*found.columns, "end.*")
    # At one place stops come before starts, seen from either side, so that spans that touch are beside each other.
    up = Window.partitionBy(*doc).orderBy("at", "opens").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*doc).orderBy(F.desc("at"), F.desc("opens")).rowsBetween(Window.unboundedPreceding, -1)
    secret, name, place = F.col("kind").isin("assign", "hex", "weak"), F.col("kind").isin("access", "user"), F.col("kind") == "endpoint"

    def near(of: Column) -> Column:
        left = F.col("start") - F.max(F.when(of & (F.col("opens") == 0), F.col("at"))).over(up)
        right = F.min(F.when(of & (F.col("opens") == 1), F.col("at"))).over(down) - F.col("stop")
        return F.coalesce(F.when(F.col("opens") == 1, left).otherwise(right) <= REACH, F.lit(False))

    found = found.withColumns({"by_secret": near(secret), "by_name": near(name), "by_place": near(place)})
    seen = [F.bool_or(c).alias(c) for c in ("covered", "by_secret", "by_name", "by_place")]
    found = found.groupBy(*doc, "kind", "start", "stop").agg(*seen)
    linked = (
        F.when(F.col("kind") == "weak", F.col("by_name") | F.col("by_place"))
        .when(F.col("kind") == "user", F.col("by_secret"))
        .otherwise(F.col("by_secret") & F.col("by_name"))
    )
    return found.where(is_base | (linked & ~F.col("covered"))).select(*doc, "kind", "start", "stop")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """For every row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:stop by start, then kind in the order of KINDS,
    comma-joined; base_sha256 is the SHA-256 of that list of base spans alone.
    """
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    item = F.struct("start", rank.alias("rank"), "stop", F.concat_ws(":", "kind", "start", "stop").alias("s"))
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}")
    per = spans(docs).groupBy("doc_id", "text_hash").agg(count("assign"), count("access"), count("hex"), F.sort_array(F.collect_list(item)).alias("all"))
    joined = lambda rows: F.array_join(F.transform(rows, lambda r: r["s"]), ",")
    base = joined(F.filter("all", lambda r: r["rank"] <= 3))
    per = per.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n_assign", "n_access", "n_hex", F.sha2(base.cast("binary"), 256).alias("base"), joined(F.col("all")).alias("list"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    out = rows.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.coalesce("base", none).alias("base_sha256"), F.coalesce("list", F.lit("")).alias("spans"))
