"""Threat detectors over parsed lines. All thresholds are parameters.

Every detector returns findings in one layout (``FINDING``), so that they can be joined with evidence lines and turned
into alerts by the same functions. Sources under attack are hot keys by nature: detectors first combine lines per
source and second (or per source and rule), map side first, and cut time into slices (``slices``), so their
tasks never hold a source's lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.scalars import all_ips, epoch_second, is_private_ip, let, lookup
from emberlog.operators import rules
from emberlog.operators.findings import alert_id
from emberlog.operators.formats.clf import bytes_number
from emberlog.operators.joins import attach
from emberlog.operators.slices import DAY, distinct_trailing, following, gap_moments, gap_sums, islands, trailing
from emberlog.schema import ALERT, MAX_AFFECTED_LINES, REMEDIATION, conform
from emberlog.session import materialize

FINDING = ["category", "severity", "subject", "first_sec", "last_sec", "n"]


def _finding(df: DataFrame, category: str | Column, severity: str | Column, subject: str, n: str,
             first: str = "first_sec", last: str = "last_sec") -> DataFrame:
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(
        as_col(category).alias("category"),
        as_col(severity).alias("severity"),
        F.col(subject).alias("subject"),
        F.col(first).cast("bigint").alias("first_sec"),
        F.col(last).cast("bigint").alias("last_sec"),
        F.col(n).cast("bigint").alias("n"),
    )


# --- logins ---------------------------------------------------------------------------


def _mentions(pieces: list[str]) -> Column:
    """Whether the message holds one of a few lower-case pieces, whatever its case."""
    text = F.lower("message")
    return reduce(lambda a, b: a | b, [text.contains(p) for p in pieces])


def _matches(rule: tuple[str, list[str]]) -> Column:
    return F.coalesce(F.when(_mentions(rule[1]), F.col("message").rlike(rule[0])), F.lit(False))


def _group(pattern: str) -> Column:
    return let(F.regexp_extract("message", pattern, 1), lambda t: F.when(t != "", t))


def _named(rule: tuple[str, list[str]]) -> Column:
    return F.when(_mentions(rule[1]), _group(rule[0]))


def login_failed() -> Column:
    """A failed login by its message, or a web request turned away with 401 or 403."""
    return _matches(rules.FAILED_LOGIN) | F.coalesce(F.col("status_code").isin(401, 403), F.lit(False))


def login_succeeded() -> Column:
    return _matches(rules.LOGIN)


def login_user() -> Column:
    """Account named in a login line; null where none is."""
    return F.coalesce("auth_user", "account_name", _group(rules.LOGIN_USER))


def privilege_use() -> Column:
    """Account that used sudo or su, failed to, or was put into a privileged group; null for other lines."""
    used = F.when(F.col("process").isin("sudo", "su"), F.coalesce(_group(rules.SUDO_COMMAND), _group(rules.SUDO_FAILURE)))
    return F.coalesce(used, _named(rules.GROUP_GRANT))


def cleared_log() -> Column:
    """The host whose log was cleared or restarted: notable, by itself no threat; null for other lines."""
    return F.when(_matches(rules.LOG_RESTART), F.coalesce("host", "source_file"))


def changed_account() -> Column:
    """Account made or changed, or the host on which permissions were opened wide; null for other lines."""
    wide = F.when(_matches(rules.MODE_CHANGE), F.col("host"))
    return F.coalesce(_named(rules.NEW_USER), _named(rules.CHANGED_USER), _named(rules.WINDOWS_ACCOUNT), wide)


def _field(column: str, keys: list[str]) -> Column:
    """A record column, else the first of the named extra fields that is there (formats without such a column)."""
    return F.coalesce(column, *[F.try_element_at("extra", F.lit(k)) for k in keys])


def requested() -> Column:
    """The path or URL that a line asks for; null for lines that are no requests."""
    return _field("path", rules.PATH_FIELDS)


def user_agent() -> Column:
    return _field("user_agent", rules.AGENT_FIELDS)


def answer_status() -> Column:
    return F.coalesce("status_code", *[F.try_element_at("extra", F.lit(k)).try_cast("int") for k in rules.STATUS_FIELDS])


def bytes_out() -> Column:
    return F.coalesce(bytes_number(F.col("bytes_sent")), *[F.try_element_at("extra", F.lit(k)).try_cast("bigint") for k in rules.BYTES_FIELDS])


def target_port() -> Column:
    """The port that a line tells a connection was made to."""
    return F.coalesce(*[F.try_element_at("extra", F.lit(k)) for k in rules.PORT_FIELDS], _named(rules.PORT))


def matching_rules(categories: list[str] | None = None) -> Column:
    """Names of the request rules a line matches, of all rules or of ``categories``.

    Paths are tested percent-decoded twice at most. Lines of other formats that name no path are tested by their message.
    """
    asked = {c: r for c, r in rules.REQUEST_RULES.items() if categories is None or c in categories}

    def flags(text: Column | None) -> Column:
        tested = {"decoded_path": text, "user_agent": user_agent()}
        hits = [F.when(tested[col].rlike(pattern), c) for c, (_, col, pattern) in asked.items()]
        return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")

    if not any(col == "decoded_path" for _, col, _ in asked.values()):
        return flags(None)
    once = let(requested(), lambda p: F.coalesce(F.try_url_decode(p), p))
    twice = let(once, lambda p: F.when(p.contains("%"), F.coalesce(F.try_url_decode(p), p)).otherwise(p))
    message = F.when(F.col("format") != "clf", F.col("message"))
    return let(F.coalesce(twice, message), flags)


def internal_peer() -> Column:
    """The other internal address of a line from an internal address: a ``dst_ip`` field, or another one in the text."""
    other = F.get(F.filter(all_ips(F.col("message")), lambda ip: ip != F.col("source_ip")), F.lit(0))
    peer = let(F.coalesce(F.try_element_at("extra", F.lit("dst_ip")), other), lambda ip: F.when(is_private_ip(ip), ip))
    return F.when(is_private_ip(F.col("source_ip")), peer)


def tag(parsed: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Add everything the detectors read out of texts, so that a stored table pays for it once.

    ``sec, login_failed, login_ok, login_user, privileged, changed, made_root, peer, rules``, and ``origin`` (address, else
    host, else file), ``target`` (path, else port), ``answered`` (status) and ``sent`` (bytes). A table that has the tags
    already is returned as it is; tags a detector does not use are never computed. With ``categories`` only these request
    rules are tested.
    """
    if "rules" in parsed.columns:
        return parsed
    return parsed.withColumns({
        "sec": epoch_second(F.col("event_ts")),
        "login_failed": login_failed(),
        "login_ok": login_succeeded(),
        "login_user": F.when(login_failed(), login_user()),
        "privileged": privilege_use(),
        "changed": changed_account(),
        "restarted": cleared_log(),
        "made_root": _matches(rules.NEW_USER) & F.col("message").rlike(rules.UID_ZERO),
        "peer": internal_peer(),
        "rules": matching_rules(categories),
        "origin": F.coalesce("source_ip", "host", "source_file"),
        "target": F.coalesce(requested(), F.concat(F.lit(":"), target_port())),
        "answered": answer_status(),
        "sent": bytes_out(),
    })


def logins_per_second(parsed: DataFrame) -> DataFrame:
    """``source_ip, sec, failed, succeeded`` for lines that tell of a login and name a source and a time."""
    told = tag(parsed).filter("(login_failed OR login_ok) AND source_ip IS NOT NULL AND sec IS NOT NULL")
    return told.groupBy("source_ip", "sec").agg(
        F.count_if("login_failed").alias("failed"), F.count_if("login_ok").alias("succeeded"))


def brute_force(parsed: DataFrame, window_seconds: int = 90, min_failures: int = 10) -> DataFrame:
    """Bursts of failed logins: runs of seconds at which the trailing window holds ``min_failures`` or more.

    ``n`` is the highest count in the burst, ``first_sec`` the second at which the threshold was reached.
    """
    failures = logins_per_second(parsed).filter("failed > 0")
    hot = trailing(failures, ["source_ip"], window_seconds, in_window=F.sum("failed")).filter(
        F.col("in_window") >= min_failures)
    bursts = islands(hot, ["source_ip"], window_seconds, peak=(F.max, "in_window"))
    return _finding(bursts, "brute_force", "HIGH", "source_ip", "peak")


def failure_bands(parsed: DataFrame, window_seconds: int = 90, high: int = 10, medium: int = 2) -> DataFrame:
    """Per source the highest number of failures in any window, banded HIGH, MEDIUM (repeated) or LOW (a single one)."""
    failures = logins_per_second(parsed).filter("failed > 0")
    counted = trailing(failures, ["source_ip"], window_seconds, in_window=F.sum("failed"))
    peaks = counted.groupBy("source_ip").agg(
        F.max("in_window").alias("peak"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))
    band = F.when(F.col("peak") >= high, "HIGH").when(F.col("peak") >= medium, "MEDIUM").otherwise("LOW")
    return _finding(peaks, "failed_login", band, "source_ip", "peak")


def credential_stuffing(parsed: DataFrame, window_seconds: int = 3600, min_users: int = 5) -> DataFrame:
    """Sources failing for many user names within one fixed window."""
    tries = (
        tag(parsed).filter("login_failed AND source_ip IS NOT NULL AND sec IS NOT NULL AND login_user IS NOT NULL")
        .select("source_ip", "sec", F.col("login_user").alias("user"), F.floor(F.col("sec") / window_seconds).alias("slot"))
    )
    # one row per user first: a source hammering one name does not weigh on the count of names
    per_user = tries.groupBy("source_ip", "slot", "user").agg(F.min("sec").alias("a"), F.max("sec").alias("b"))
    users = per_user.groupBy("source_ip", "slot").agg(
        F.count(F.lit(1)).alias("users"), F.min("a").alias("first_sec"), F.max("b").alias("last_sec"))
    return _finding(users.filter(F.col("users") >= min_users), "credential_stuffing", "HIGH", "source_ip", "users")


def sliding_stuffing(parsed: DataFrame, window_seconds: int = 3600, min_users: int = 5) -> DataFrame:
    """Runs of seconds at which a source failed for ``min_users`` names or more within the trailing window.

    ``n`` is the most, ``first_sec`` the first try in the first of these windows.
    """
    tries = tag(parsed).filter("login_failed AND source_ip IS NOT NULL AND sec IS NOT NULL").select("source_ip", "sec", "login_user")
    users = distinct_trailing(tries, ["source_ip"], "login_user", window_seconds, "users").filter(F.col("users") >= min_users)
    runs = islands(users, ["source_ip"], window_seconds, peak=(F.max, "users"), since=(F.min, "since"))
    return _finding(runs, "credential_stuffing", "HIGH", "source_ip", "peak", "since")


def success_after_failures(parsed: DataFrame, window_seconds: int = 3600, min_failures: int = 1) -> DataFrame:
    """Logins that succeed in a second after failures of the same source; ``n`` counts those failures."""
    seen = trailing(
        logins_per_second(parsed), ["source_ip"], window_seconds, until=1,
        before=F.sum("failed"), since=F.min(F.when(F.col("failed") > 0, F.col("sec"))))
    hits = seen.filter((F.col("succeeded") > 0) & (F.col("before") >= min_failures))
    return _finding(hits, "success_after_failures", "CRITICAL", "source_ip", "before", "since", "sec")


# --- web requests -----------------------------------------------------------------------


def matched_rules(parsed: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Lines with the request rules they match, one row per line and rule; one pass for all rules, no join."""
    lines = tag(parsed, categories).withColumn("category", F.explode("rules"))
    return lines.filter(F.col("category").isin(categories)) if categories else lines


def request_attacks(parsed: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Findings per origin and rule; command injection answered with a 2xx status is CRITICAL."""
    per_rule = (
        matched_rules(parsed, categories)
        .groupBy("origin", "category")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.min("sec").alias("first_sec"),
            F.max("sec").alias("last_sec"),
            F.max(F.col("answered").between(200, 299)).alias("answered"),
        )
    )
    base = lookup({c: r[0] for c, r in rules.REQUEST_RULES.items()}, F.col("category"))
    severity = F.when((F.col("category") == "command_injection") & F.col("answered"), "CRITICAL").otherwise(base)
    return _finding(per_rule, F.col("category"), severity, "origin", "lines")


def scan(parsed: DataFrame, window_seconds: int = 3600, min_targets: int = 20, min_missing: int = 20,
         target: str = "target", approximate: bool = False) -> DataFrame:
    """Sources touching many distinct targets (paths or ports), or missing pages, within one fixed window."""
    lines = tag(parsed).filter("source_ip IS NOT NULL AND sec IS NOT NULL").select(
        "source_ip", "sec", F.col(target).alias("target"),
        F.coalesce((F.col("answered") == 404).cast("bigint"), F.lit(0)).alias("missing"),
    ).withColumn("slot", F.floor(F.col("sec") / window_seconds))
    times = F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec")
    if approximate:
        slots = lines.groupBy("source_ip", "slot").agg(
            F.approx_count_distinct("target").alias("targets"), F.sum("missing").alias("missing"), *times)
    else:
        per_target = lines.groupBy("source_ip", "slot", "target").agg(
            F.sum("missing").alias("missing"), F.min("sec").alias("a"), F.max("sec").alias("b"))
        slots = per_target.groupBy("source_ip", "slot").agg(
            F.count("target").alias("targets"), F.sum("missing").alias("missing"),
            F.min("a").alias("first_sec"), F.max("b").alias("last_sec"))
    hits = slots.filter((F.col("targets") >= min_targets) | (F.col("missing") >= min_missing)).withColumn(
        "n", F.greatest("targets", "missing"))
    return _finding(hits, "scan", "HIGH", "source_ip", "n")


def sliding_scan(parsed: DataFrame, window_seconds: int = 3600, min_targets: int = 20, min_missing: int = 20, target: str = "target") -> DataFrame:
    """Runs of seconds at which a source touched many distinct targets, or missing pages, within the trailing window.

    Unlike ``scan`` no border between windows can hide one. ``n`` is the most that any of the windows holds, ``first_sec`` the
    first visit in the first of them.
    """
    lines = tag(parsed).filter("source_ip IS NOT NULL AND sec IS NOT NULL").select(
        "source_ip", "sec", F.col(target).alias("target"), (F.col("answered") == 404).alias("missing"))
    key = ["source_ip"]
    targets = distinct_trailing(lines, key, "target", window_seconds, "n").filter(F.col("n") >= min_targets)
    misses = lines.filter("missing").groupBy(*key, "sec").agg(F.count(F.lit(1)).alias("misses"))
    missing = trailing(misses, key, window_seconds, n=F.sum("misses"), since=F.min("sec")).filter(F.col("n") >= min_missing).drop("misses")
    hot = targets.unionByName(missing).groupBy(*key, "sec").agg(F.max("n").alias("n"), F.min("since").alias("since"))
    runs = islands(hot, key, window_seconds, peak=(F.max, "n"), since=(F.min, "since"))
    return _finding(runs, "scan", "HIGH", "source_ip", "peak", "since")


def exfiltration(parsed: DataFrame, min_bytes: int = 10**9, window_seconds: int = DAY) -> DataFrame:
    """Destinations that were sent ``min_bytes`` or more within one fixed window (a day)."""
    sent = tag(parsed).select(
        "source_ip", "sec", F.col("sent").alias("bytes")
    ).filter("source_ip IS NOT NULL AND sec IS NOT NULL AND bytes IS NOT NULL")
    slots = sent.groupBy("source_ip", F.floor(F.col("sec") / window_seconds).alias("slot")).agg(
        F.sum("bytes").alias("bytes"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))
    return _finding(slots.filter(F.col("bytes") >= min_bytes), "exfiltration", "HIGH", "source_ip", "bytes")


def _median(values: Column) -> Column:
    """The median of an array of numbers; null if it is empty."""
    middle = lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / F.lit(2.0)
    return let(F.sort_array(values), middle)


def unusual_transfer(parsed: DataFrame, window_seconds: int = DAY, history: int = 14, min_history: int = 5, min_score: float = 6.0,
                     min_bytes: int = 10**6) -> DataFrame:
    """Destinations sent far more within one window than is their habit.

    The habit are the windows with traffic among the ``history`` windows before: their median, and the median of their
    distances to it, both untouched by single large transfers. A window's score is its distance to the median in units of
    1.4826 times the second one (the deviation if the habit is normal), but of a tenth of the median at least. Found are
    windows of ``min_bytes`` or more with a score of ``min_score`` or more, if the habit knows ``min_history`` windows.
    """
    sent = tag(parsed).select("source_ip", "sec", F.col("sent").alias("bytes")).filter("source_ip IS NOT NULL AND sec IS NOT NULL AND bytes IS NOT NULL")
    slots = sent.groupBy("source_ip", F.floor(F.col("sec") / window_seconds).alias("slot")).agg(
        F.sum("bytes").alias("bytes"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))
    before = Window.partitionBy("source_ip").orderBy("slot").rangeBetween(-history, -1)  # one row per source and window
    known = slots.withColumn("_before", F.collect_list("bytes").over(before)).filter((F.size("_before") >= min_history) & (F.col("bytes") >= min_bytes))
    known = known.withColumn("_median", _median(F.col("_before")))
    away = _median(F.transform("_before", lambda b: F.abs(b - F.col("_median"))))
    unit = F.greatest(away * 1.4826, F.col("_median") * 0.1, F.lit(1.0))
    odd = known.filter((F.col("bytes") - F.col("_median")) / unit >= min_score)
    return _finding(odd, "unusual_transfer", "MEDIUM", "source_ip", "bytes")


# --- hosts and accounts -------------------------------------------------------------------


def privilege_escalation(parsed: DataFrame, min_lines: int = 1) -> DataFrame:
    per_account = (
        tag(parsed).filter("privileged IS NOT NULL").groupBy(F.col("privileged").alias("account"))
        .agg(F.count(F.lit(1)).alias("lines"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))
    )
    return _finding(per_account.filter(F.col("lines") >= min_lines), "privilege_escalation", "HIGH", "account", "lines")


def account_change(parsed: DataFrame) -> DataFrame:
    """New users, changed users and wide permission changes; an account made with user id 0 is CRITICAL."""
    per_account = (
        tag(parsed).filter("changed IS NOT NULL").groupBy(F.col("changed").alias("account"))
        .agg(F.count(F.lit(1)).alias("lines"), F.max("made_root").alias("root"),
             F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))
    )
    severity = F.when(F.col("root"), "CRITICAL").otherwise("HIGH")
    return _finding(per_account, "account_change", severity, "account", "lines")


def clears(parsed: DataFrame) -> DataFrame:
    """Logs that were cleared or logging services that were restarted, per host: INFO."""
    per_host = (
        tag(parsed).filter("restarted IS NOT NULL").groupBy(F.col("restarted").alias("host"))
        .agg(F.count(F.lit(1)).alias("lines"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))
    )
    return _finding(per_host, "log_restart", "INFO", "host", "lines")


def connection_pairs(parsed: DataFrame) -> DataFrame:
    """``src, dst, sec`` of lines naming two internal addresses: a ``dst_ip`` field, or the second in the text."""
    return tag(parsed).filter("peer IS NOT NULL AND sec IS NOT NULL").select(
        F.col("source_ip").alias("src"), F.col("peer").alias("dst"), "sec")


def lateral_movement(pairs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Internal pairs absent from ``baseline`` (``src, dst``); both sides are reduced to distinct pairs first."""
    seen = pairs.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("lines"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))
    new = seen.join(baseline.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    per_source = new.groupBy("src").agg(
        F.count(F.lit(1)).alias("targets"), F.min("first_sec").alias("first_sec"), F.max("last_sec").alias("last_sec"))
    return _finding(per_source, "lateral_movement", "MEDIUM", "src", "targets")


def beacon(parsed: DataFrame, min_gaps: int = 5, max_cv: float = 0.1, min_mean_gap: float = 10) -> DataFrame:
    """Sources whose gaps between distinct seconds are regular: deviation over mean below ``max_cv``.

    Gaps shorter than ``min_mean_gap`` seconds on average are a flood rather than a beacon.
    """
    return regular_gaps(gap_sums(seconds_of_sources(parsed), ["source_ip"]), min_gaps, max_cv, min_mean_gap)


def seconds_of_sources(parsed: DataFrame) -> DataFrame:
    """``source_ip, sec``: the distinct seconds at which each source is seen."""
    return tag(parsed).filter("source_ip IS NOT NULL AND sec IS NOT NULL").groupBy("source_ip", "sec").agg(F.lit(1).alias("_one")).drop("_one")


def regular_gaps(sums: DataFrame, min_gaps: int = 5, max_cv: float = 0.1, min_mean_gap: float = 10) -> DataFrame:
    """The findings of ``beacon`` from each source's sums of gaps."""
    regular = gap_moments(sums).filter(
        (F.col("gaps") >= min_gaps) & (F.col("mean_gap") >= min_mean_gap)
        & (F.col("dev_gap") / F.col("mean_gap") < max_cv))
    return _finding(regular, "beacon", "HIGH", "source_ip", "gaps")


#: Parts that each doubling of a gap is cut into: a period is found to about six hundredths of itself.
OCTAVE = 16


def _bin(gap: Column) -> Column:
    """Where a gap lies on a scale of OCTAVE parts per doubling."""
    power = F.length(F.bin(gap)) - 1
    return (power * OCTAVE + F.floor(gap * OCTAVE / F.pow(F.lit(2.0), power)) - OCTAVE).cast("int")


def _bin_start(place: Column) -> Column:
    return F.pow(F.lit(2.0), F.floor(place / OCTAVE)) * (OCTAVE + F.pmod(place, F.lit(OCTAVE))) / OCTAVE


def gap_histogram(parsed: DataFrame, reach: int = 8) -> DataFrame:
    """``source_ip, target, bin, gaps, total``: gaps between a visit and the ``reach`` next ones of the same pair, by length.

    Beats stay at their distance however many other visits come between, as long as fewer than ``reach`` do.
    """
    visits = tag(parsed).filter("source_ip IS NOT NULL AND sec IS NOT NULL").select("source_ip", F.coalesce("target", F.lit("")).alias("target"), "sec")
    later = following(visits, ["source_ip", "target"], reach)
    gaps = later.select("source_ip", "target", F.explode(F.transform("later", lambda t: t - F.col("sec"))).alias("gap"))
    return gaps.groupBy("source_ip", "target", _bin(F.col("gap")).alias("bin")).agg(F.count(F.lit(1)).alias("gaps"), F.sum("gap").alias("total"))


def periodic_contact(parsed: DataFrame, min_beats: int = 8, min_period: float = 30, min_share: float = 0.5, min_excess: float = 4.0,
                     reach: int = 8) -> DataFrame:
    """Sources that come back to a target at a period, amid other visits and with beats missed.

    A period is two neighbouring bins of ``gap_histogram``, so that jitter across a border does no harm. It is a beat if as many
    gaps lie there as ``min_share`` of the beats that fit between the pair's first and last visit, and ``min_excess`` times as
    many as visits at random moments would put there (n visits in T seconds make about n * n / T * width gaps of a bin's
    width). Of a pair's periods the one with most gaps counts, the shortest of several. ``n`` is the period in seconds.
    """
    pair = ["source_ip", "target"]
    bins = gap_histogram(parsed, reach)
    both = bins.unionByName(bins.withColumn("bin", F.col("bin") - 1)).groupBy(*pair, "bin").agg(F.sum("gaps").alias("gaps"), F.sum("total").alias("total"))
    timed = tag(parsed).filter("source_ip IS NOT NULL AND sec IS NOT NULL").withColumn("target", F.coalesce("target", F.lit("")))
    seconds = timed.groupBy(*pair, "sec").agg(F.lit(1).alias("_one")).groupBy(*pair).agg(
        F.count(F.lit(1)).alias("visits"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))
    found = both.filter(F.col("gaps") >= min_beats).join(seconds, pair)
    span, period = F.col("last_sec") - F.col("first_sec"), F.col("total") / F.col("gaps")
    width = _bin_start(F.col("bin") + 2) - _bin_start(F.col("bin"))
    beats = found.filter(
        (period >= min_period) & (F.col("gaps") * period >= min_share * span) & (F.col("gaps") * span >= min_excess * F.col("visits") * F.col("visits") * width))
    best = beats.withColumn("period", F.floor(period)).groupBy(*pair, "first_sec", "last_sec").agg(
        F.min(F.struct((-F.col("gaps")).alias("few"), F.col("period"))).alias("_best"))
    per_source = best.groupBy("source_ip").agg(F.min(F.struct("_best", "target", "first_sec", "last_sec")).alias("_b")).select(
        "source_ip", "_b.first_sec", "_b.last_sec", F.col("_b._best.period").alias("period"))
    return _finding(per_source, "periodic_contact", "MEDIUM", "source_ip", "period")


def c2_sources(parsed: DataFrame) -> DataFrame:
    """Lines from sources that asked for a known command-and-control path at least once."""
    known = materialize(matched_rules(parsed, ["c2_path"]).select("source_ip").distinct())
    return attach(parsed, known, ["source_ip"], "left_semi")


# --- findings to alerts ---------------------------------------------------------------------


def remediation_for(category: Column, subject: Column) -> Column:
    """Suggested step as text; null where the category has none, or where it acts on an address and the subject is none.

    Nothing is ever run.
    """

    def text(i: int) -> Column:
        return F.replace(lookup({c: r[i] for c, r in rules.RESPONSES.items()}, category), F.lit("{s}"), subject)

    undo = text(4)
    step = F.struct(text(2).alias("action"), text(3).alias("command"), (undo != "").alias("reversible"),
                    undo.alias("undo_command")).cast(REMEDIATION)
    address = subject.rlike(r"^(\d{1,3}(\.\d{1,3}){3}|[0-9a-fA-F]*:[0-9a-fA-F:.]+)$")
    return F.when((text(3) != "") & (~text(2).isin("block_ip", "kill_session") | address), step)


def finding_id() -> Column:
    """The id of a finding: the same when later lines carry it on, so that the longer version replaces the shorter one."""
    moment = F.when(F.col("category").isin(*rules.MOMENTS), F.col("last_sec"))
    return alert_id(F.col("category"), F.col("subject"), F.coalesce(F.col("first_sec"), F.lit(-1)), F.coalesce(moment, F.lit(-1)))


def with_evidence(findings: DataFrame, lines: DataFrame, max_lines: int = MAX_AFFECTED_LINES) -> DataFrame:
    """Add ``affected_lines``, ``source_file`` and ``log_format``: the first lines behind each finding.

    Lines without a valid time stand behind the findings that have none; they are put at second -1.

    ``findings`` is read more than once, so pass a stored or checkpointed table. ``lines``: ``category, subject, sec,
    raw, line_no, source_file, format``. A finding takes lines of its category and subject from its first second to
    its last. Findings of one subject may overlap, so lines are not joined by time: of each second only the first
    ``max_lines`` lines are kept (the rank filter also runs before the shuffle), these are numbered per category and
    subject, each finding learns the number its first line has, and fetches the numbers that follow by equality.
    """
    keys = ["category", "subject"]
    timeless = F.lit(-1).cast("bigint")
    fid = alert_id(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*keys, "first_sec", "last_sec")])
    keyed = findings.withColumns({"_fid": fid, "_first": F.coalesce("first_sec", timeless), "_last": F.coalesce("last_sec", timeless)})
    lines = lines.withColumn("sec", F.coalesce("sec", timeless))
    place = ["source_file", "line_no"]
    second = Window.partitionBy(*keys, "sec").orderBy(*place)
    spans = materialize(keyed.groupBy(*keys).agg(F.min("_first").alias("_from"), F.max("_last").alias("_to")))
    kept = materialize(
        attach(lines, spans, keys).filter("sec BETWEEN _from AND _to").drop("_from", "_to")
        .withColumn("_rn", F.row_number().over(second)).filter(F.col("_rn") <= max_lines).drop("_rn")
    )
    marks = keyed.select(*keys, F.col("_first").alias("sec"), "_last", "_fid", F.lit(0).alias("_line"))
    both = kept.withColumn("_line", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    both = both.withColumn("_day", F.floor(F.col("sec") / DAY))
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = both.groupBy(*keys, "_day").agg(F.sum("_line").alias("_n")).select(
        *keys, "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_day").orderBy("sec", "_line", *place).rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        both.withColumn("_at", F.coalesce(F.sum("_line").over(inside), F.lit(0)))
        .join(days.hint("merge"), [*keys, "_day"]).withColumn("_at", F.col("_at") + F.col("_offset"))
    )
    wanted = numbered.filter("_line = 0").select(
        *keys, "_fid", "_last", F.explode(F.sequence("_at", F.col("_at") + (max_lines - 1))).alias("_at"))
    found = numbered.filter("_line = 1").select(*keys, "_at", "sec", "raw", "source_file", "format")
    packed = (
        wanted.join(found, [*keys, "_at"]).filter("sec <= _last")
        .groupBy("_fid").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("_at", "raw"))), lambda x: x["raw"]).alias("affected_lines"),
            F.min_by("source_file", "_at").alias("source_file"),
            F.min_by("format", "_at").alias("log_format"),
        )
    )
    return keyed.drop("_first", "_last").join(packed, "_fid", "left").withColumnRenamed("_fid", "id")


def evidence_lines(parsed: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Lines that can stand behind a finding, once per category they serve; one pass over the parsed table.

    ``categories``: those among the findings, if known; lines that serve no other are then left out early.
    """
    ip = F.col("source_ip")
    failed, ok, always = F.col("login_failed"), F.col("login_ok"), F.lit(True)
    behind = {
        "brute_force": (failed, ip),
        "failed_login": (failed, ip),
        "credential_stuffing": (failed, ip),
        "success_after_failures": (failed | ok, ip),
        "scan": (F.col("target").isNotNull(), ip),
        "exfiltration": (F.col("sent").isNotNull(), ip),
        "unusual_transfer": (F.col("sent").isNotNull(), ip),
        "beacon": (always, ip),
        "periodic_contact": (always, ip),
        "privilege_escalation": (always, F.col("privileged")),
        "account_change": (always, F.col("changed")),
        "log_restart": (always, F.col("restarted")),
        "lateral_movement": (F.col("peer").isNotNull(), ip),
        **{c: (F.array_contains("rules", c), F.col("origin")) for c in rules.REQUEST_RULES},
    }

    def hit(category: str, when: Column, subject: Column) -> Column:
        pair = F.struct(F.lit(category).alias("category"), subject.alias("subject"))
        return F.when(when & subject.isNotNull(), pair)

    served = [c for c in behind if categories is None or c in categories] or ["beacon"]
    hits = F.array_compact(F.array(*[hit(c, *behind[c]) for c in served]))
    lines = tag(parsed).withColumn("_hit", F.explode(hits))
    return lines.select("_hit.category", "_hit.subject", "sec", "raw", "line_no", "source_file", "format")


def to_alerts(findings: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """Findings (with evidence, if added) in the alert layout; the subject is the indicator."""
    c, s = F.col("category"), F.col("subject")

    def text(i: int) -> Column:
        return F.replace(lookup({k: r[i] for k, r in rules.RESPONSES.items()}, c), F.lit("{s}"), s)

    shaped = findings.withColumns({
        "id": finding_id(),
        "title": text(0),
        "description": F.concat(text(0), F.lit(" ("), F.col("n").cast("string"), F.lit(")")),
        "recommendation": text(1),
        "iocs": F.array(s),
        "timestamp_first": F.timestamp_seconds("first_sec"),
        "timestamp_last": F.timestamp_seconds("last_sec"),
        "generated_at": generated_at if generated_at is not None else F.current_timestamp(),
        "remediation": remediation_for(c, s),
    })
    return conform(shaped, ALERT)


def detect_all(parsed: DataFrame) -> DataFrame:
    """Findings of all detectors that need nothing but the parsed lines, with their default thresholds."""
    # HIGH bands are bursts, which brute_force finds one by one
    found = [
        brute_force(parsed), failure_bands(parsed).filter("severity <> 'HIGH'"), clears(parsed), sliding_stuffing(parsed), success_after_failures(parsed),
        request_attacks(parsed), sliding_scan(parsed), exfiltration(parsed), unusual_transfer(parsed), privilege_escalation(parsed),
        account_change(parsed), beacon(parsed), periodic_contact(parsed),
    ]
    return reduce(DataFrame.unionByName, found)
