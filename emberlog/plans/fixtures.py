"""Log corpora and stored tables rendered from the test tables, so that parsers and reports run on known answers.

Corpora have the layout ``source_file, line_no, raw``. Each uses every row of its table. Times are cut to seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.schema import SEVERITIES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _address(prefix: str, number: Column, parts: int) -> Column:
    """An address whose last ``parts`` parts are a number in base 256."""
    shown = [F.shiftright(number, 8 * k).bitwiseAND(255).cast("string") for k in reversed(range(parts))]
    return F.concat_ws(".", F.lit(prefix), *shown)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the user's number as the last three parts of the address ``10.x.y.z`` and the time cut to seconds."""
    return table(spark, sf_dir, "events").withColumns({
        "at": F.date_trunc("second", F.col("ts").cast("timestamp")),
        "ip": _address("10", F.col("user_id"), 3),
    })


def _corpus(rows: DataFrame, source: Column, raw: Column) -> DataFrame:
    return rows.select(source.alias("source_file"), F.col("event_id").alias("line_no"), raw.alias("raw"))


def _fmt(pattern: str) -> Column:
    return F.date_format("at", pattern)


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.lit(values), (index % len(values) + 1).cast("int"))


FAILED_USERS = ["root", "admin", "invalid user test", "oracle", "guest"]


def _login_message() -> Column:
    failed = F.concat(F.lit("Failed password for "), _pick(FAILED_USERS, F.col("event_id")), F.lit(" from "), "ip",
                      F.lit(" port 22 ssh2"))
    accepted = F.concat(F.lit("Accepted password for deploy from "), "ip", F.lit(" port 22 ssh2"))
    return F.when(F.col("event_type") == "error", failed).otherwise(accepted)


def bsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lpad(F.dayofmonth("at").cast("string"), 2, " ")
    pid = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(
        F.concat(F.lit("["), (F.col("event_id") + 1000).cast("string"), F.lit("]")))
    raw = F.concat(_fmt("MMM"), F.lit(" "), day, F.lit(" "), _fmt("HH:mm:ss"), F.lit(" web"),
                   (F.col("user_id") % 3).cast("string"), F.lit(" sshd"), pid, F.lit(": "), _login_message())
    return _corpus(events(spark, sf_dir), F.lit("bsd.log"), raw)


def journald(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(_fmt("yyyy-MM-dd HH:mm:ss"), F.lit(" web"), (F.col("user_id") % 3).cast("string"),
                   F.lit(" sshd[77]: "), _login_message())
    return _corpus(events(spark, sf_dir), F.lit("journald.log"), raw)


def rfc5424(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 3
    zone = F.when(kind == 0, "Z").when(kind == 1, ".123Z").otherwise("+02:00")
    shifted = F.when(kind == 2, F.col("at") + F.expr("INTERVAL 2 HOURS")).otherwise(F.col("at"))
    raw = F.concat(F.lit("<"), (F.col("event_id") % 192).cast("string"), F.lit(">1 "),
                   F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss"), zone,
                   F.lit(" h"), (F.col("user_id") % 7).cast("string"),
                   F.lit(" app"), (F.col("event_id") % 5).cast("string"),
                   F.lit(" 12 - - event of type "), "event_type", F.lit(" from "), "ip")
    return _corpus(events(spark, sf_dir), F.lit("rfc5424.log"), raw)


AGENTS = ["", "sqlmap/1.7", "-", "Mozilla/5.0 (X11)"]


def clf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = F.col("event_id"), F.col("event_id") % 10
    query = (
        F.when(n == 0, "?q=1%27%20OR%201%3D1")
        .when(n == 1, "?f=..%2F..%2Fetc%2Fpasswd")
        .when(n == 2, "?q=%3Cscript%3Ealert(1)%3C%2Fscript%3E")
        .when(n == 3, "?c=1%3Bcat%20%2Ftmp%2Fx")
        .otherwise("")
    )
    verb = F.when(F.col("event_type") == "purchase", "POST").otherwise("GET")
    path = F.concat(F.lit("/p/"), (e % 50).cast("string"), query)
    request = F.when(n == 4, F.concat(F.lit("GET "), path)).when(n == 5, F.lit("-")).otherwise(
        F.concat(verb, F.lit(" "), path, F.lit(" HTTP/1.1")))
    status = (
        F.when(F.col("event_type") == "error", "500").when(F.col("event_type") == "click", "404")
        .when(F.col("event_type") == "signup", "401").otherwise("200")
    )
    size = F.when(e % 11 == 0, "-").otherwise(F.round(F.col("value") * 100).cast("bigint").cast("string"))
    tail = F.when(e % 4 == 0, "").otherwise(F.concat(
        F.lit(' "'), F.when(e % 4 == 3, "http://example.com/r").otherwise("-"), F.lit('" "'), _pick(AGENTS, e), F.lit('"')))
    half = e % 2 == 1  # every other line in the zone +0530
    local = F.when(half, F.col("at") + F.expr("INTERVAL 330 MINUTES")).otherwise(F.col("at"))
    raw = F.concat(
        F.when(e % 97 == 0, "-").otherwise(F.col("ip")), F.lit(" - "),
        F.when(e % 3 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise("-"),
        F.lit(" ["), F.date_format(local, "dd/MMM/yyyy:HH:mm:ss"), F.when(half, " +0530").otherwise(" +0000"),
        F.lit('] "'), request, F.lit('" '), status, F.lit(" "), size, tail)
    return _corpus(events(spark, sf_dir), F.lit("clf.log"), raw)


JSON_LEVELS = ["fatal", "err", "Warn", "information", "trace", "Notice"]


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six shapes by ``event_id mod 6``; the last two are not JSON objects."""
    e = F.col("event_id")
    level = _pick(JSON_LEVELS, F.floor(e / 6))
    text = F.concat(F.lit("event "), e.cast("string"), F.lit(" by "), "ip")

    def obj(*pairs) -> Column:
        return F.to_json(F.struct(*[v.alias(k) for k, v in pairs]), {"ignoreNullFields": "false"})

    null = F.lit(None).cast("string")
    shape = (
        F.when(e % 6 == 0, obj(("timestamp", F.concat(_fmt("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))), ("level", level),
                               ("message", F.concat(F.lit("m"), e.cast("string"))), ("src_ip", F.col("ip")),
                               ("host", F.lit("h1")), ("request_id", e)))
        .when(e % 6 == 1, obj(("timestamp", null), ("time", _fmt("yyyy-MM-dd'T'HH:mm:ss")), ("msg", text)))
        .when(e % 6 == 2, obj(("@timestamp", F.concat(_fmt("yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250+02:00"))),
                              ("severity", level), ("text", F.lit("")), ("remote_addr", F.col("ip"))))
        .when(e % 6 == 3, obj(("ts", _fmt("yyyy-MM-dd HH:mm:ss")), ("lvl", level), ("log", text),
                              ("client_ip", F.lit("")), ("node", F.lit("n7")), ("nested", F.struct(e.alias("k"))),
                              ("dst_ip", F.concat(F.lit("192.168.0."), (e % 20).cast("string")))))
        .when(e % 6 == 4, F.concat(F.lit('["'), "ip", F.lit('"]')))
        .otherwise(F.concat(obj(("a", e)), F.lit(" and "), "ip"))
    )
    return _corpus(events(spark, sf_dir), F.lit("app.jsonl"), shape)


VIEWER_HEADER = ["Level", "Date and Time", "Source", "Event ID", "Task Category", "Computer", "Message", "Keywords"]
SHELL_HEADER = ["TimeCreated", "Id", "LevelDisplayName", "Task", "Message", "Computer", "UserName"]


def windows_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files by ``user_id mod 2``; every twentieth row has two fields only."""
    e, odd = F.col("event_id"), F.col("user_id") % 2 == 1
    eid = e.cast("string")
    viewer_level = F.when(F.col("event_type") == "error", "Audit Failure").otherwise("Information")
    quoted = F.concat(F.lit('"logon ""'), "event_type", F.lit('"" from '), "ip", F.lit(', id '), eid, F.lit('"'))
    viewer = F.concat_ws(",", viewer_level, _fmt("M/d/yyyy h:mm:ss a"), F.lit("Security"), eid, F.lit("Logon"),
                         F.lit(" PC1 "), quoted, F.when(e % 2 == 0, "").otherwise("kw"))
    shell = F.concat_ws(",", _fmt("yyyy-MM-dd HH:mm:ss"), eid, F.lit("Verbose"), F.lit("None"),
                        F.concat(F.lit("plain message "), eid), F.lit("SRV2"), F.concat(F.lit("DOM\\u"), F.col("user_id")))
    raw = F.when(e % 20 == 0, F.concat(F.lit("short,"), eid)).when(odd, shell).otherwise(viewer)
    source = F.when(odd, "shell.csv").otherwise("viewer.csv")
    rows = events(spark, sf_dir)
    header = F.when(odd, ",".join(SHELL_HEADER)).otherwise(",".join(VIEWER_HEADER))
    heads = rows.select(source.alias("source_file"), F.lit(-1).cast("bigint").alias("line_no"), header.alias("raw"))
    return _corpus(rows, source, raw).unionByName(heads.distinct())


def admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host administration lines: new users, changed users, sudo use and failures, cron sessions."""
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    uid = F.when(e % 50 == 0, "0").otherwise("1001")
    body = (
        F.when(F.col("event_type") == "signup", F.concat(
            F.lit("useradd[9]: new user: name=u"), u, F.lit(", UID="), uid, F.lit(", GID=5, home=/h, shell=/bin/sh")))
        .when(F.col("event_type") == "view", F.concat(F.lit("usermod[9]: change user 'u"), u, F.lit("' GID from '1' to '0'")))
        .when(F.col("event_type") == "purchase", F.concat(
            F.lit("sudo[9]: u"), u, F.lit(" : TTY=pts/1 ; PWD=/ ; USER=root ; COMMAND=/bin/sh")))
        .when(F.col("event_type") == "error", F.concat(
            F.lit("sudo[9]: pam_unix(sudo:auth): authentication failure; logname=u"), u, F.lit(" uid=1")))
        .otherwise(F.lit("CRON[9]: pam_unix(cron:session): session opened for user root by (uid=0)"))
    )
    raw = F.concat(_fmt("yyyy-MM-dd HH:mm:ss"), F.lit(" web0 "), body)
    return _corpus(events(spark, sf_dir), F.lit("admin.log"), raw)


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All formats, and document lines as a file of no format."""
    parts = [bsd, journald, rfc5424, clf, json_lines, windows_csv, document_lines]
    out = parts[0](spark, sf_dir)
    for part in parts[1:]:
        out = out.unionByName(part(spark, sf_dir))
    return out


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document; line numbers leave room for 2**20 lines per document."""
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
        .filter(F.col("raw").rlike(r"\S"))
        .select(F.lit("notes.txt").alias("source_file"),
                (F.col("doc_id") * 2**20 + F.col("pos")).alias("line_no"), "raw")
    )


def documents_as_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one long line of its source, with a made-up format."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("source_file"), d.alias("line_no"), F.col("text").alias("raw"),
        F.when(d % 3 == 0, "unknown").when(d % 3 == 1, "syslog").otherwise("json").alias("format"),
        F.when(d % 4 != 0, F.timestamp_seconds(d * 60)).alias("event_ts"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert per order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    severity = _pick(SEVERITIES, F.left("o_orderpriority", F.lit(1)).cast("int") - 1)
    ip = _address("10", c + 65536, 3)
    second = (
        F.when(k % 5 == 0, F.concat(F.lit("c"), (c % 500).cast("string"), F.lit("@example.com")))
        .when(k % 5 == 1, F.concat(F.lit("/var/log/app/"), (k % 50).cast("string")))
        .when(k % 5 == 2, F.md5((c % 200).cast("string")))
        .when(k % 5 == 3, F.concat(F.lit("user"), (c % 100).cast("string")))
        .otherwise(ip)
    )
    iocs = F.when(k % 10 == 9, F.array().cast("array<string>")).when(
        k % 10 == 8, F.array(ip, second, F.lit("a"), F.lit("b"))).otherwise(F.array(ip, second))
    line = F.concat(F.lit("order "), k.cast("string"), F.lit(" line "))
    lines = F.transform(F.slice(F.sequence(F.lit(1), F.lit(6)), 1, (c % 6).cast("int")),
                        lambda i: F.concat(line, F.rpad(i.cast("string"), 130, "x")))
    undo = F.when(k % 8 == 0, F.lit("undo it")).otherwise("")
    step = F.struct(
        F.lit("block_ip").alias("action"),
        F.when(k % 4 == 3, "").otherwise(F.concat(F.lit("block "), ip)).alias("command"),
        (k % 8 == 0).alias("reversible"), undo.alias("undo_command"))
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"),
        severity.alias("severity"),
        F.concat(F.lit("Status "), "o_orderstatus", F.lit(" customer "), c.cast("string")).alias("title"),
        F.concat(F.lit("Total "), F.floor("o_totalprice").cast("string"), F.lit(" "), "o_orderpriority",
                 F.lit(" for order "), k.cast("string"), F.lit(" "), F.repeat(F.lit("z"), 90)).alias("description"),
        F.lit("Review the order").alias("recommendation"),
        iocs.alias("iocs"),
        lines.alias("affected_lines"),
        F.lit("syslog").alias("log_format"),
        F.concat(F.lit("/var/log/f"), (c % 10).cast("string")).alias("source_file"),
        (k % 100).alias("chunk_index"),
        F.when(k % 3 != 0, F.col("o_orderdate").cast("timestamp")).alias("timestamp_first"),
        F.when(k % 3 != 0, (F.col("o_orderdate") + F.expr("INTERVAL 90 SECONDS")).cast("timestamp")).alias("timestamp_last"),
        F.col("o_orderdate").cast("timestamp").alias("generated_at"),
        F.when(k % 4 >= 1, step).alias("remediation"),
    )


def line_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert per order line, with one indicator of each kind in turn; line 7 names its indicator twice."""
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    value = (
        F.when(n % 5 == 0, _address("11", p, 3))
        .when(n % 5 == 1, F.md5((p % 300).cast("string")))
        .when(n % 5 == 2, F.concat(F.lit("p"), (p % 400).cast("string"), F.lit("@example.org")))
        .when(n % 5 == 3, F.when(p % 2 == 0, F.concat(F.lit("/opt/"), (p % 90).cast("string"))).otherwise(
            F.concat(F.lit("C:\\tmp\\"), (p % 90).cast("string"))))
        .otherwise(F.concat(F.lit("word"), (p % 70).cast("string")))
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("generated_at"),
        F.when(n == 7, F.array(value, value)).otherwise(F.array(value)).alias("iocs"),
        F.col("l_suppkey").alias("suppkey"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model answer per assistant turn, in six shapes by ``(conv_id + turn) mod 6``."""
    text, kind = F.col("text"), (F.col("conv_id") + F.col("turn")) % 6

    def alert(**fields: Column) -> Column:
        return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))

    def body(items: Column, summary: Column) -> Column:
        quoted = F.to_json(F.struct(summary.alias("s")))
        return F.concat(F.lit('{"alerts":['), items, F.lit('],"chunk_summary":'),
                        F.substr(quoted, F.lit(6), F.length(quoted) - 6), F.lit("}"))

    step = F.struct(F.lit("block_ip").alias("action"), F.lit("block it").alias("command"),
                    F.lit(False).alias("reversible"))
    idle = F.struct(F.lit("none").alias("action"), F.lit("").alias("command"))
    many = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("l"), i.cast("string")))
    one = alert(severity=F.lit("high"), title=F.left(text, F.lit(100)), description=text, recommendation=F.lit("r"),
                iocs=F.array(F.lit("10.0.0.1"), F.col("conv_id").cast("string")), affected_lines=many, remediation=step)
    two = alert(severity=F.lit("Bogus"), description=F.lit("d"), remediation=idle)
    head = F.left(text, F.lit(20))
    shape = (
        F.when(kind == 0, F.concat(F.lit("Here you go:\n```json\n"), body(one, head), F.lit("\n```\nDone.")))
        .when(kind == 1, body(F.lit('"just text"'), head))
        .when(kind == 2, F.concat(F.lit("No answer: "), text))
        .when(kind == 3, body(F.lit(""), F.lit("quiet")))
        .when(kind == 4, body(F.concat(F.lit('"text",'), two, F.lit(",3")), F.lit("")))
        .otherwise(body(F.concat(one, F.lit(","), two), F.lit("both")))
    )
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("source_file"),
        F.col("turn").alias("chunk_index"),
        shape.alias("response"),
        F.lit("syslog").alias("log_format"),
        F.timestamp_seconds(F.col("turn") * 60).alias("timestamp_first"),
        F.timestamp_seconds(F.col("turn") * 60 + 30).alias("timestamp_last"),
        F.array(F.left(text, F.lit(30)), F.lit("second")).alias("first_lines"),
    )


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second answers: for conversations with an even number, one good object."""
    rows = responses(spark, sf_dir).select("source_file", "chunk_index")
    number = F.replace("source_file", F.lit("conv-"), F.lit("")).cast("bigint")
    good = F.lit('{"alerts":[{"severity":"LOW","title":"repaired"}],"chunk_summary":"again"}')
    return rows.filter(number % 2 == 0).withColumn("repaired_response", good)


def attack_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as attack-pattern objects, written to JSON and read back."""
    from emberlog.operators.intel import ATTACK_OBJECT

    d = F.col("doc_id")
    ref = lambda s, i: F.struct(F.lit(s).alias("source_name"), i.alias("external_id"))
    phase = lambda c, p: F.struct(F.lit(c).alias("kill_chain_name"), p.alias("phase_name"))
    tid = F.concat(F.lit("T"), (d + 1000).cast("string"))
    references = F.when(d % 5 == 0, F.array(ref("other", F.lit("X")))).otherwise(
        F.array(ref("other", F.lit("X")), ref("mitre-attack", tid)))
    phases = F.when(d % 11 == 0, F.lit(None)).otherwise(F.array(
        phase("mitre-attack", F.col("lang")), phase("lockheed", F.lit("no")), phase("mitre-attack", F.col("source"))))
    obj = F.struct(
        F.when(d % 13 == 0, "malware").otherwise("attack-pattern").alias("type"),
        F.concat(F.lit("attack-pattern--"), d.cast("string")).alias("id"),
        F.concat(F.lit("Technique "), d.cast("string")).alias("name"),
        F.when(d % 17 == 0, "  ").otherwise(F.col("text")).alias("description"),
        F.when(d % 7 == 0, True).alias("revoked"),
        (d % 19 == 0).alias("x_mitre_deprecated"),
        references.alias("external_references"),
        phases.alias("kill_chain_phases"),
    )
    return table(spark, sf_dir, "documents").select(F.from_json(F.to_json(obj), ATTACK_OBJECT).alias("o")).select("o.*")


def cve_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as vulnerability items, written to JSON and read back."""
    from emberlog.operators.intel import CVE_ITEM

    d = F.col("doc_id")
    desc = lambda lang, v: F.struct(F.lit(lang).alias("lang"), v.alias("value"))
    text = F.when(d % 7 == 0, F.concat(F.lit("** REJECT ** "), "text")).when(
        d % 11 == 0, F.concat(F.lit("** RESERVED ** "), "text")).otherwise(F.col("text"))
    texts = F.when(d % 10 == 3, F.array(desc("fr", F.lit("non")))).otherwise(
        F.array(desc("fr", F.lit("non")), desc("en", text)))
    score = (F.col("n_chars") % 100 / 10).cast("decimal(3,1)")
    cvss = lambda outer, s: F.struct(F.struct(s.alias("baseScore")).alias(outer))
    impact = F.struct(
        F.when(d % 3 != 0, cvss("cvssV3", F.when(d % 4 == 0, F.lit(0).cast("decimal(3,1)")).otherwise(score)))
        .alias("baseMetricV3"),
        F.when(d % 2 == 0, cvss("cvssV2", F.lit("5.5").cast("decimal(3,1)"))).alias("baseMetricV2"),
    )
    item = F.struct(
        F.struct(
            F.struct(F.concat(F.lit("CVE-2024-"), d.cast("string")).alias("ID")).alias("CVE_data_meta"),
            F.struct(texts.alias("description_data")).alias("description"),
        ).alias("cve"),
        impact.alias("impact"),
    )
    return table(spark, sf_dir, "documents").select(F.from_json(F.to_json(item), CVE_ITEM).alias("o")).select("o.*")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def vector_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("intel "), F.col("vec_id").cast("string"), F.lit(" label "), F.col("label").cast("string")).alias("text"))


def grow(part: str, log: str, before: bytes, hold: int) -> bytes:
    """Append the text files of the folder ``part`` to the file ``log``, after the bytes ``before``; the last ``hold`` bytes are given back.

    Streams through this process a megabyte at a time, as the process that writes a log would.
    """
    from pyarrow import fs

    from emberlog.sources.files import file_system

    (source, parts), (target, path) = file_system(part), file_system(log)
    target.create_dir(path.rpartition("/")[0])
    held = before
    with target.open_append_stream(path) as out:
        for info in sorted(source.get_file_info(fs.FileSelector(parts)), key=lambda f: f.path):
            if not info.base_name.startswith("part-"):
                continue
            with source.open_input_stream(info.path) as file:
                while data := file.read(1 << 20):
                    held += data
                    out.write(held[:len(held) - hold])
                    held = held[len(held) - hold:]
    return held
