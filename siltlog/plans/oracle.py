"""DuckDB SQL for the named queries. It starts from the native event columns, not from log lines."""

from __future__ import annotations

from siltlog.plans import reports

LOG = r"""
ev AS (
  SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS dt, user_id AS u, event_type,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k,
         (event_id * 4) // (SELECT count(*) FROM events) AS no
  FROM events),
ev2 AS (SELECT * FROM ev UNION ALL SELECT event_id, dt, u, event_type, k, 4 FROM ev WHERE event_id % 50 = 0),
log AS (
  SELECT 'access.log.' || CAST(no AS VARCHAR) AS file, event_id AS line_key,
    CASE WHEN u % 30 = 11 THEN 'admin.example.com' WHEN k % 3 = 0 THEN 'www.example.com' ELSE 'blog.example.org' END AS vhost,
    CASE WHEN u % 25 = 1 THEN '114.134.' || (184 + (u // 256) % 8) || '.' || (u % 256)
         ELSE '10.' || (u % 7) || '.' || ((u * 13) % 256) || '.' || (u % 256) END AS ip,
    dt,
    CASE WHEN u % 10 = 3 AND k < 10 THEN '/wp-admin/' || k WHEN u % 20 = 7 AND k = 50 THEN '/robots.txt'
         WHEN k % 5 = 0 THEN '/pics/' || k || '.jpg' WHEN k % 7 = 0 THEN '/main.css' ELSE '/en/' || k || '.html' END AS url,
    CAST(CASE event_type WHEN 'error' THEN 404 WHEN 'signup' THEN 302 ELSE 200 END AS INTEGER) AS http,
    CASE WHEN u % 20 = 9 AND k < 5 THEN 'http://x.semalt.com/' WHEN k % 2 = 0 THEN '-' ELSE 'http://r.example.net/' || (k % 10) END AS ref,
    CASE WHEN u % 10 = 5 THEN 'Googlebot/2.1 (+http://g/)' ELSE 'Mozilla/5.0 (v' || (u % 4) || ')' END AS ua
  FROM ev2),
num AS (
  SELECT *, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536
         + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS n
  FROM log)"""
MATCH = {
    "ip": "ip IN ('10.4.52.4', '10.1.104.8')",
    "net": "n BETWEEN 1921431552 AND 1921433599",
    "url": r"regexp_matches(url, '/wp\-admin')",
    "ref": r"regexp_matches(ref, '\Wsemalt')",
    "ua": "regexp_matches(ua, '[bB]ot[^a-zA-Z]')",
    "vhost": "regexp_matches(vhost, '^admin')",
}
SECOND = r"regexp_matches(url, '(\.(jpg|jpeg|png|gif|css|ico|woff|ttf|svg|eot\??))|(robots\.txt|sitemap\.xml|googlecea.+\.html)$')"


#: Bytes of a line and its end, made again from its fields.
SIZE = """length(ip || ' ' || vhost || ' - [' || strftime(dt, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET ' || url || ' HTTP/1.1" ' || http || ' 10 "' || ref || '" "' || ua || '"') + 1"""


def _verdict(options: bool = False) -> str:
    m = MATCH
    return (
        f"CASE WHEN {m['ip']} THEN 'ignore' " + (f"WHEN {SECOND} THEN 'skip' " if options else "") + f"WHEN {m['url']} OR {m['ref']} THEN 'block' "
        + ("WHEN http = 404 THEN 'skip' " if options else "") + f"WHEN {m['ua']} THEN 'ignore' WHEN {m['vhost']} THEN 'block' WHEN url = '/robots.txt' THEN 'ignore' WHEN {m['net']} THEN 'ignore' ELSE 'accept' END"
    )


JUDGED = f"""{LOG},
judged AS (SELECT *, {_verdict()} AS verdict FROM num),
rejected AS (SELECT ip, bool_or(verdict = 'block') AS blocked FROM judged WHERE verdict IN ('ignore', 'block') GROUP BY ip),
acc AS (
  SELECT *, coalesce(lag(http) OVER (PARTITION BY file, ip ORDER BY line_key) IN (301, 302), false) AND http NOT IN (301, 302) AS was_rd
  FROM judged WHERE verdict = 'accept' AND ip NOT IN (SELECT ip FROM rejected))"""
KEYS = "dt, ip, http, was_rd, vhost, url, ref, ua"
FLAT = f"""{JUDGED},
flat AS (SELECT * FROM acc QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY file, line_key) = 1)"""


def _star(rows: str) -> str:
    dims = ", ".join(
        f"{c} AS (SELECT row_number() OVER (ORDER BY min(id)) AS id, {c} AS value FROM ided GROUP BY {c})" for c in ("vhost", "url", "ref", "ua")
    )
    joins = " ".join(f"JOIN {c} ON ided.{c} = {c}.value" for c in ("vhost", "url", "ref", "ua"))
    ids = ", ".join(f"{c}.id AS id_{c}" for c in ("vhost", "url", "ref", "ua"))
    return f"""{FLAT},
ided AS (SELECT *, row_number() OVER (ORDER BY file, line_key) AS id FROM {rows}),
{dims},
entries AS (SELECT ided.id AS id, dt, ip, http, was_rd, {ids} FROM ided {joins})"""


def texts() -> dict[str, str]:
    line = "file, line_key, vhost, ip, dt, url, http, ref, ua"
    log, judged, flat, stored = f"WITH {LOG} ", f"WITH {JUDGED} ", f"WITH {FLAT} ", f"WITH {_star('flat')} "
    out = {
        "parse_clf": f"{log} SELECT {line} FROM log",
        "parse_prefixed": f"{log} SELECT {line.replace(' dt,', ' dt + INTERVAL 1 SECOND AS dt,')} FROM log",
        "parse_rejects": f"{log} SELECT file, line_key FROM log WHERE line_key % 10 = 0",
        "vhost_default": f"{log} SELECT file, CASE WHEN line_key % 4 <> 0 THEN vhost WHEN file = 'access.log.0' THEN 'files.example.com' ELSE '-' END AS vhost, count(*) AS n FROM log GROUP BY 1, 2",
        "truncate_values": f"{log} SELECT file, line_key, left(vhost, 9) AS vhost, ip, dt, left(url, 9) AS url, http, left(ref, 9) AS ref, left(ua, 9) AS ua FROM log",
        **{f"match_{k}": f"{log} SELECT file, line_key FROM num WHERE {m}" for k, m in MATCH.items()},
        "secondary_skip": f"{log} SELECT file, line_key FROM log WHERE {SECOND}",
        "exclude_codes": f"{log} SELECT file, line_key FROM log WHERE http NOT IN (404, 302)",
        "benign_bot": f"{log} SELECT file, line_key FROM log WHERE url = '/robots.txt'",
        "verdict_chain": f"{judged} SELECT file, line_key, verdict FROM judged",
        "verdict_chain_options": f"{log} SELECT file, line_key, {_verdict(True)} AS verdict FROM num",
        "rejected_ips": f"{judged} SELECT ip, blocked FROM rejected",
        "reject_totals": f"{judged} SELECT count(*) AS rejected, CAST(count(*) FILTER (blocked) AS BIGINT) AS blocked FROM rejected",
        "blocked_ips_sorted": f"{judged} SELECT DISTINCT ip, n AS ip_num FROM num WHERE ip IN (SELECT ip FROM rejected WHERE blocked) ORDER BY ip_num, ip",
        "new_blocked_ips": f"{judged} SELECT DISTINCT ip FROM num WHERE ip IN (SELECT ip FROM rejected WHERE blocked) AND n % 2 <> 0",
        "purged_counts": f"{judged} SELECT ip, blocked, count(*) AS n_rows FROM judged JOIN rejected USING (ip) GROUP BY ip, blocked",
        "file_counters": f"{judged} SELECT file, count(*) AS n_lines, count(*) AS n_parsed, CAST(count(*) FILTER (verdict = 'accept') AS BIGINT) AS n_accepted FROM judged GROUP BY file",
        "was_redirect": f"{judged} SELECT file, line_key, was_rd FROM acc",
        "entries_flat": f"{flat} SELECT {KEYS} FROM flat",
        "dedupe_entries": f"{flat} SELECT file, line_key FROM flat",
        "entries_star": f"{stored} SELECT id, {KEYS} FROM ided",
        "hits_for_ip": f"{stored} SELECT count(http) AS hits FROM entries WHERE ip = '10.6.78.6'",
        "records_at_dt": f"{stored} SELECT id, {KEYS} FROM ided WHERE dt = (SELECT max(dt) FROM ided) ORDER BY id",
        "distinct_ips": f"{stored} SELECT DISTINCT ip FROM entries",
        "distinct_times": f"{stored} SELECT DISTINCT dt FROM entries",
        "count_ips": f"{stored} SELECT count(DISTINCT ip) AS n FROM entries",
        "not_stored_yet": f"{flat} SELECT file, line_key FROM acc WHERE http = 404",
        "ip_to_long": f"{log} SELECT DISTINCT ip, n, (n // 16777216) * 16777216 + (n % 16777216) // 256 AS n_short FROM num",
        "cidr_network": f"{log} SELECT DISTINCT ip, n - n % 2048 AS net FROM num",
        "month_distance": f"{log} SELECT CAST(12 * (2024 - year(dt)) + 3 - month(dt) AS INTEGER) AS months, count(*) AS n FROM log GROUP BY 1",
        "dt_format": f"{log} SELECT strftime(dt, '%Y-%m-%d+%H:%M') AS minute, count(*) AS n FROM log GROUP BY 1",
        "ledger_upsert": f"{log} SELECT file AS name, CASE WHEN file > 'access.log.2' THEN max(dt) ELSE min(dt) END AS dt, count(*) AS bytes, CAST(file > 'access.log.2' AS BIGINT) AS records FROM log GROUP BY file",
        "streaming_ingest": f"{flat} SELECT {KEYS} FROM flat",
        "star_incremental": f"{flat} SELECT {KEYS} FROM flat",
        "incremental_skip": f"{judged} SELECT file, count(*) AS n_lines, count(*) AS n_parsed, CAST(count(*) FILTER (verdict = 'accept') AS BIGINT) AS n_accepted FROM judged WHERE file NOT IN ('access.log.1', 'access.log.3') GROUP BY file",
        "file_ledger": f"{judged} SELECT file AS name, CAST(sum({SIZE}) AS BIGINT) AS bytes, CAST(count(*) FILTER (verdict = 'accept') AS BIGINT) AS records FROM judged GROUP BY file",
        "q01_duplicate_entries_raw": f"WITH {_star('acc')} {reports.sql('q01', dialect='duckdb')}",
    }
    for c in ("vhost", "url", "ref", "ua"):
        out[f"dim_{c}"] = f"{stored} SELECT id, value FROM {c}"
    for name in reports.REPORTS:
        out[name] = out[f"{name}_sql"] = f"{stored} {reports.sql(name, dialect='duckdb')}"
    return out
