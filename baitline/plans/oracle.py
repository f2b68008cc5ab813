"""SQL checks of the registered queries.

Each string computes the same result as the query of that name with another engine's
functions, over the same tables. Recurring parts (derived URLs, parsing, features,
rules, fusion) are common table expressions assembled here.
"""

from __future__ import annotations

from baitline.functions import fixed_values as fv
from baitline.operators import intel, risk, rules
from baitline.operators.audit import CONCENTRATION_PERCENTS

ORACLE_SQL: dict[str, str] = {}


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def word32(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def unit(text: str) -> str:
    return f"({word32(text)} / 4294967295.0)"


# --- derived tables -----------------------------------------------------------------------

CUT = """cut AS (
  SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS h,
         regexp_replace(url, '^[a-z]+://[^/]*', '') AS tail FROM pages)"""

PROBES = CUT + """,
probes AS (
  SELECT page_id, url AS page_url, unnest(range(16)) AS variant, unnest([
    url,
    'http://user' || page_id || ':pw@' || h || '/login' || tail,
    'http://10.' || (page_id % 300) || '.3.7/account/verify?a=1&&b=2',
    'https://paypal-security.' || h || '/verify/account?login=1',
    'HTTPS://WWW.' || upper(h) || '.:8443/Secure/%2Flogin%3Fa%20b#frag',
    'https://google-login.' || page_id || '.example.xyz/a/b/c/d/e/f/g?a=1&b=2&c=3&d=4&e=5&f=6&g=7&h=8',
    '  accounts.google.com' || tail,
    'https://a.b.c.d.e.' || substr(md5(url), 1, 12) || '.co.uk/' || md5(url) || '-' || upper(md5(url)) || '/' || md5(url)
      || '/' || md5(url) || '/' || md5(url) || '/' || md5(url),
    'https://microsoft.' || h || '.top/0x1F/deadbeef99/signin?x=@1',
    'https://xn--' || h || ':99999/recover/wallet',
    'not a valid url ' || page_id,
    '',
    'https://' || h || '/' || repeat('a', 2050),
    'ftp://' || h || tail,
    'https://' || h || ':8080/ünï/login_confirm-update?q=é&sign-in=verify.',
    'https://' || repeat('sub-', 20) || h || '/update%payment%now%'
  ]) AS url FROM cut)"""

URI = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def norm(source: str) -> str:
    """Tables up to ``norm``: rows of ``source`` with a normalisable url, and its parts."""
    return rf"""trimmed AS (
  SELECT *, regexp_replace(regexp_replace(url, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '[\t\r\n]', '', 'g') AS t0 FROM {source}),
prefixed AS (SELECT *, CASE WHEN contains(t0, '://') THEN t0 ELSE 'https://' || t0 END AS s FROM trimmed WHERE t0 <> ''),
pieces AS (
  SELECT *, lower(regexp_extract(s, '{URI}', 1)) AS scheme, regexp_extract(s, '{URI}', 2) AS auth,
    regexp_extract(s, '{URI}', 3) AS path, regexp_extract(s, '{URI}', 4) AS query, regexp_extract(s, '{URI}', 5) AS fragment
  FROM prefixed),
ends AS (SELECT *, regexp_extract(auth, '([^@]*)$', 1) AS ep FROM pieces),
hosts AS (
  SELECT *, CASE WHEN contains(auth, '@') THEN left(auth, length(auth) - length(ep) - 1) END AS userinfo,
    rtrim(lower(split_part(ep, ':', 1)), '.') AS host, substr(ep, length(split_part(ep, ':', 1)) + 2) AS port_text
  FROM ends),
ports AS (SELECT *, TRY_CAST(port_text AS INTEGER) AS port FROM hosts),
norm AS (
  SELECT *, scheme || '://' || coalesce(userinfo || '@', '') || host || coalesce(':' || port, '') || path
    || CASE WHEN query <> '' THEN '?' || query ELSE '' END || CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END AS nu
  FROM ports WHERE port_text = '' OR port <= 65535)"""


IS_IP = (
    "(regexp_full_match(host, '(0|[1-9][0-9]{0,2})([.](0|[1-9][0-9]{0,2})){3}') AND "
    "list_max(list_transform(string_split(host, '.'), lambda x: coalesce(TRY_CAST(x AS INTEGER), 999))) <= 255)"
)
LABELS = "string_split(host, '.')"
REGISTERED = (
    f"(CASE WHEN {IS_IP} THEN host WHEN array_to_string({LABELS}[-2:], '.') IN ({quoted(fv.TWO_LEVEL_SUFFIXES)}) "
    f"THEN array_to_string({LABELS}[-3:], '.') ELSE array_to_string({LABELS}[-2:], '.') END)"
)
PROBE_NORM = PROBES + ",\n" + norm("probes")
PAGE_HOSTS = (
    "page_hosts AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS domain, "
    f"{word32('url')} % 2 AS label FROM pages)"
)


def count_of(text: str, symbol: str) -> str:
    return f"(length({text}) - length(replace({text}, '{symbol}', '')))"


def matches(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def entropy(text: str) -> str:
    return (
        f"(CASE WHEN {text} = '' THEN 0.0 ELSE list_sum(list_transform(map_values(list_histogram(string_split({text}, ''))), "
        f"lambda k: -(k / length({text})::DOUBLE) * log2(k / length({text})::DOUBLE))) END)"
    )


def non_empty(text: str, separator: str) -> str:
    return f"len(list_filter(string_split({text}, '{separator}'), lambda x: x <> ''))"


def listed(words) -> str:
    return f"[{quoted(words)}]"


# --- features ---------------------------------------------------------------------------

TOKENS = "regexp_split_to_array(lower(nu), '[^a-z0-9]+')"
FEATURE_WORD_COUNT = (
    f"(len(list_intersect(list_distinct({TOKENS}), {listed([w for w in fv.FEATURE_WORDS if '-' not in w])})) + "
    "CASE WHEN regexp_matches(lower(nu), '(^|[^a-z0-9])sign-in([^a-z0-9]|$)') THEN 1 ELSE 0 END)"
)
RULE_WORD_COUNT = (
    r"len(list_filter(regexp_split_to_array(lower(nu), '[^\p{L}\p{N}_]+'), "
    f"lambda x: list_contains({listed(fv.RULE_WORDS)}, x)))"
)
LOOSE_IP = (
    "(regexp_full_match(host, '[0-9]{1,3}([.][0-9]{1,3}){3}') AND "
    "list_max(list_transform(string_split(host, '.'), lambda x: coalesce(TRY_CAST(x AS INTEGER), 999))) <= 255)"
)
TLD = "(CASE WHEN contains({0}, '.') THEN string_split({0}, '.')[-1] ELSE '' END)"
PREFIX = "rtrim(left(host, length(host) - length(rd)), '.')"
SUBDOMAINS = (
    f"(CASE WHEN {PREFIX} = '' THEN 0 ELSE len(string_split({PREFIX}, '.')) - "
    f"CASE WHEN string_split({PREFIX}, '.')[1] = 'www' THEN 1 ELSE 0 END END)"
)


def share(part: str, whole: str = "length(nu)") -> str:
    return f"(CASE WHEN {whole} > 0 THEN {part}::DOUBLE / {whole} ELSE 0.0 END)"


def as_flag(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1 ELSE 0 END)"


FEATURE_SQL = {
    "url_length": "length(nu)", "hostname_length": "length(host)", "path_length": "length(path)",
    "query_length": "length(query)", "fragment_length": "length(fragment)",
    "letter_count": matches("nu", r"\p{L}"), "digit_count": matches("nu", r"\p{Nd}"),
    "special_char_count": matches("nu", r"[^\p{L}\p{N}]"),
    "digit_ratio": share(matches("nu", r"\p{Nd}")), "letter_ratio": share(matches("nu", r"\p{L}")),
    "special_char_ratio": share(matches("nu", r"[^\p{L}\p{N}]")),
    "dot_count": count_of("nu", "."), "hyphen_count": count_of("nu", "-"), "slash_count": count_of("nu", "/"),
    "underscore_count": count_of("nu", "_"), "at_count": count_of("nu", "@"), "equals_count": count_of("nu", "="),
    "question_mark_count": count_of("nu", "?"), "ampersand_count": count_of("nu", "&"),
    "percent_count": count_of("nu", "%"), "hash_count": count_of("nu", "#"),
    "subdomain_count": SUBDOMAINS, "is_ip_address": as_flag(LOOSE_IP), "has_punycode": as_flag("contains(host, 'xn--')"),
    "has_credentials": as_flag("userinfo IS NOT NULL"), "has_https": as_flag("scheme = 'https'"),
    "encoded_char_count": matches("nu", "%[0-9a-fA-F]{2}"),
    "hex_sequence_count": "(" + matches("nu", "0x[0-9a-fA-F]+") + " + len(list_filter(regexp_split_to_array(nu, '[^a-zA-Z0-9]+'), "
                          "lambda x: regexp_full_match(x, '[0-9a-fA-F]{8,}'))))",
    "has_url_encoding": as_flag("regexp_matches(nu, '%[0-9a-fA-F]{2}')"),
    "path_depth": non_empty("path", "/"), "query_parameter_count": non_empty("query", "&"),
    "suspicious_word_count": FEATURE_WORD_COUNT, "has_suspicious_word": as_flag(FEATURE_WORD_COUNT + " > 0"),
    "has_suspicious_tld": as_flag(f"{TLD.format('rd')} IN ({quoted(fv.FEATURE_TLDS)})"),
    "url_entropy": entropy("nu"), "hostname_entropy": entropy("host"), "path_entropy": entropy("path"),
    "subdomain_ratio": f"(CASE WHEN host = '' THEN 0.0 ELSE {SUBDOMAINS}::DOUBLE / len({LABELS}) END)",
    "path_to_url_ratio": share("length(path)"), "query_to_url_ratio": share("length(query)"),
}
assert list(FEATURE_SQL) == fv.FEATURE_NAMES
DOUBLES = {n for n in fv.FEATURE_NAMES if n.endswith(("_ratio", "_entropy"))}


def feature(name: str, rounded: bool = True) -> str:
    if name in DOUBLES:
        return (f"round({FEATURE_SQL[name]}, 6)" if rounded else FEATURE_SQL[name]) + f" AS {name}"
    return f"CAST({FEATURE_SQL[name]} AS INTEGER) AS {name}"


WITH_RD = f"rd_norm AS (SELECT *, {REGISTERED} AS rd FROM norm)"
FEATURES_CTE = WITH_RD + ",\nfeats AS (SELECT page_id, variant, nu, " + ", ".join(
    feature(n, False) for n in fv.FEATURE_NAMES) + " FROM rd_norm)"

# --- rules --------------------------------------------------------------------------------

BRAND_HITS = "list_filter([" + ", ".join(
    f"CASE WHEN contains(host, '{b}') AND rd NOT IN ({quoted(d)}) THEN '{b}' END" for b, d in sorted(fv.BRAND_DOMAINS.items())
) + "], lambda x: x IS NOT NULL)"
SIGNAL_SQL = {
    "is_https": "scheme = 'https'", "is_ip_address": IS_IP, "has_credentials": "userinfo IS NOT NULL",
    "url_length": "CAST(length(nu) AS INTEGER)", "hostname_length": "CAST(length(host) AS INTEGER)",
    "path_length": "CAST(length(path) AS INTEGER)", "query_length": "CAST(length(query) AS INTEGER)",
    "subdomain_count": f"CAST(CASE WHEN {IS_IP} THEN 0 ELSE greatest(len({LABELS}) - 2, 0) END AS INTEGER)",
    "excessive_subdomains": f"NOT {IS_IP} AND len({LABELS}) - 2 >= 4",
    "suspicious_tld": f"{TLD.format('host')} IN ({quoted(fv.RULE_TLDS)})",
    "suspicious_word_count": f"CAST({RULE_WORD_COUNT} AS INTEGER)", "has_suspicious_words": f"{RULE_WORD_COUNT} > 0",
    "brand_impersonation": f"len({BRAND_HITS}) > 0", "brand_matches": f"array_to_string({BRAND_HITS}, ' | ')",
    "has_at_symbol": "contains(nu, '@')", "has_percent_encoding": "contains(nu, '%')",
    "has_hex_encoding": "regexp_matches(nu, '%[0-9a-fA-F]{2}')",
    "excessive_percent_encoding": f"{count_of('nu', '%')} >= 3",
    "path_depth": f"CAST({non_empty('path', '/')} AS INTEGER)", "deep_path": f"{non_empty('path', '/')} >= 6",
    "suspicious_path_structure": f"regexp_matches(lower(path), '{'|'.join(fv.AUTH_PATH_PARTS)}')",
    "query_parameter_count": "CAST(CASE WHEN query = '' THEN 0 ELSE len(string_split(query, '&')) END AS INTEGER)",
    "many_query_parameters": "query <> '' AND len(string_split(query, '&')) >= 8",
    "hostname_entropy": entropy("host"), "path_entropy": entropy("path"),
    "high_hostname_entropy": f"{entropy('host')} >= 4.0", "high_path_entropy": f"{entropy('path')} >= 4.0",
    "very_long_url": "length(nu) >= 200", "very_long_hostname": "length(host) >= 80", "insecure_http": "scheme = 'http'",
}
SIGNALS_CTE = WITH_RD + ",\nsig AS (SELECT page_id, variant, page_url, nu, host, rd, " + ", ".join(
    f"{e} AS {n}" for n, e in SIGNAL_SQL.items()) + " FROM rd_norm)"


def rule_condition(text: str) -> str:
    words = {"words>=3": "suspicious_word_count >= 3", "words>=2": "suspicious_word_count >= 2",
             "words 1-2": "suspicious_word_count BETWEEN 1 AND 2"}
    return " AND ".join(words.get(p, p) for p in text.split(" & "))


SCORED_CTE = (
    SIGNALS_CTE
    + ",\nruled AS (SELECT *, CAST(least(100, "
    + " + ".join(f"CASE WHEN {rule_condition(c)} THEN {p} ELSE 0 END" for c, p, _ in rules.RULES)
    + ") AS INTEGER) AS rule_score, list_filter(["
    + ", ".join(f"CASE WHEN {rule_condition(c)} THEN '{m}' END" for c, _, m in rules.RULES)
    + "], lambda x: x IS NOT NULL) AS rule_reasons FROM sig)"
)
RULE_LEVEL = "CASE WHEN rule_score >= 60 THEN 'HIGH' WHEN rule_score >= 30 THEN 'MEDIUM' WHEN rule_score >= 10 THEN 'LOW' ELSE 'MINIMAL' END"

# --- threat reports -------------------------------------------------------------------------

VERDICTS = """verdicts AS (
  SELECT p.url, CASE WHEN event_type = 'error' AND p.page_id % 4 = 0 THEN 'malicious'
      WHEN event_type = 'click' AND p.page_id % 4 IN (0, 1) AND value > 40 THEN 'suspicious'
      WHEN event_type = 'signup' THEN 'timeout' WHEN event_type = 'view' THEN 'harmless' ELSE 'undetected' END AS verdict
  FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages))"""
STATES = """states AS (
  SELECT p.url, CASE arg_max(event_type, event_id) WHEN 'error' THEN 'error' WHEN 'signup' THEN 'queued' ELSE 'completed' END AS state
  FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages) GROUP BY p.url)"""


def reports(timeouts: bool) -> str:
    extra = " + \"timeout\"" if timeouts else ""
    return VERDICTS + ",\n" + STATES + ",\ncounted AS (SELECT url, " + ", ".join(
        f"CAST(count(*) FILTER (verdict = '{v}') AS INTEGER) AS \"{v}\"" for v in intel.VERDICTS
    ) + f""" FROM verdicts GROUP BY url),
totals AS (SELECT *, malicious + suspicious + harmless + undetected{extra} AS total_engines FROM counted),
reports AS (SELECT *, CASE WHEN total_engines > 0
    THEN round(least((malicious + suspicious * 0.5::DOUBLE) * 100.0::DOUBLE / total_engines, 100.0), 2) ELSE 0.0 END AS threat_score FROM totals JOIN states USING (url))"""


def report_reasons(status: str = "'completed'", score: str = "threat_score") -> str:
    return f"""list_filter([
    CASE WHEN {status} <> 'completed' THEN replace('{intel.INCOMPLETE}', '{{s}}', {status}) END,
    CASE WHEN malicious > 0 THEN replace('{intel.FOUND_MALICIOUS}', '{{n}}', malicious::VARCHAR)
         WHEN suspicious > 0 THEN replace('{intel.FOUND_SUSPICIOUS}', '{{n}}', suspicious::VARCHAR) ELSE '{intel.FOUND_NOTHING}' END,
    CASE WHEN {score} >= 50 THEN '{intel.LEVEL_HIGH}' WHEN {score} >= 20 THEN '{intel.LEVEL_ELEVATED}' END
  ], lambda x: x IS NOT NULL)"""


# probes looked up by their own URL (which has no report) and without a lookup; failed reports are empty
NO_REPORT = "(variant IN (3, 8, 15) OR r.url IS NULL OR state = 'error')"
INTEL_COLUMNS = f"""CASE WHEN variant = 15 THEN 'disabled' WHEN variant IN (3, 8) OR r.url IS NULL THEN 'unavailable'
      WHEN state = 'completed' THEN 'success' ELSE state END AS intel_status, """ + ", ".join(
    f"CASE WHEN {NO_REPORT} THEN 0 ELSE {c} END AS {c}" for c in ("malicious", "suspicious", "harmless", "undetected", "total_engines")
) + f""", CASE WHEN {NO_REPORT} THEN 0.0 ELSE threat_score END AS intel_score,
    CASE WHEN {NO_REPORT} THEN [] ELSE {report_reasons("state")} END AS intel_reasons"""

# --- fusion -----------------------------------------------------------------------------------

SCAN_CTE = (
    PROBE_NORM + ",\n" + SCORED_CTE + ",\n" + reports(False)
    + f""",
scan AS (SELECT s.*, CASE WHEN variant % 7 <> 6 THEN {unit("'u' || nu")} END AS p_url,
    CASE WHEN variant % 5 <> 4 THEN {unit("'h' || nu")} END AS p_host, {INTEL_COLUMNS}
  FROM ruled s LEFT JOIN reports r ON lower(trim(r.url)) = lower(trim(s.page_url)))"""
)


def floors(policy: risk.Policy, contract: str) -> str:
    names = risk.SIGNAL_SOURCES[contract]
    usable = [(sig, f) for sig, f in policy.floors if all(s in names for s in sig)]
    return ", ".join(f"CASE WHEN {' AND '.join(names[s] for s in sig)} THEN {float(f)} ELSE 0 END" for sig, f in usable)


def fused(policy: risk.Policy, contract: str, source: str = "scan", name: str = "fused") -> str:
    m, r, t = policy.with_intel
    a, b = policy.without_intel
    weighted = (
        f"CASE WHEN intel_status = 'success' THEN model_score * {m} + rule_score * {r} + intel_score * {t} "
        f"ELSE model_score * {a} + rule_score * {b} END"
    )
    if policy.clean_rules:
        weighted = f"CASE WHEN rule_score <= 0 THEN least(model_score * {policy.clean_rules[0]}, {policy.clean_rules[1]}) ELSE {weighted} END"
    by_host = "0.0"
    if policy.host_floors:
        by_host = "CASE " + " ".join(f"WHEN p_host >= {p} THEN {float(f)}" for p, f in policy.host_floors) + " ELSE 0.0 END"
    if policy.agreement_floor is not None:
        agreed = f"greatest(r2, {policy.agreement_floor})"
    else:
        agreed = (
            "CASE WHEN rule_score > 0 THEN greatest(r2, least(69.0, model_score * 0.65 + rule_score * 0.35)) "
            "WHEN intel_status = 'success' AND malicious > 0 THEN greatest(r2, 70.0) "
            "WHEN intel_status = 'success' AND suspicious > 0 THEN greatest(r2, 60.0) ELSE least(r2, 39.0) END"
        )
    trusted = (
        f"rd IN ({quoted(fv.TRUSTED_DOMAINS)})" if policy.trusted_by == "registered_domain"
        else "(" + " OR ".join(f"host = '{d}' OR host LIKE '%.{d}'" for d in fv.TRUSTED_DOMAINS) + ")"
    )
    n = name
    return f"""{n}_0 AS (SELECT *, CASE WHEN p_url IS NOT NULL AND p_host IS NOT NULL THEN p_url * 100.0::DOUBLE * 0.35::DOUBLE + p_host * 100.0::DOUBLE * 0.65::DOUBLE
      WHEN p_host IS NOT NULL THEN p_host * 100.0 WHEN p_url IS NOT NULL THEN p_url * 100.0 ELSE 0.0 END::DOUBLE AS model_score,
      {trusted} AS trusted_domain,
      (intel_status = 'success' AND total_engines >= 10) AS enough,
      coalesce(p_url >= 0.85 AND p_host >= 0.75, false) AS agree FROM {source}),
{n}_1 AS (SELECT *, greatest({weighted}, rule_score)::DOUBLE AS r1 FROM {n}_0),
{n}_2 AS (SELECT *, greatest(r1, {floors(policy, contract)}, {by_host}) AS r2 FROM {n}_1),
{n}_3 AS (SELECT *, CASE WHEN agree THEN {agreed} ELSE r2 END AS r3 FROM {n}_2),
{n}_4 AS (SELECT *, greatest(r3, CASE WHEN NOT enough THEN 0.0 WHEN malicious >= 3 THEN 85.0 WHEN malicious >= 1 THEN 70.0
      WHEN suspicious >= 3 THEN 60.0 ELSE 0.0 END) AS r4,
      (trusted_domain AND rule_score < 30 AND NOT (enough AND malicious >= 3)) AS protected FROM {n}_3),
{n} AS (SELECT *, least(100.0, greatest(0.0, CASE WHEN protected THEN least(r4, 25.0)
      WHEN rule_score = 0 AND p_host < 0.40 THEN least(r4, 39.0) ELSE r4 END)) AS risk_raw,
      CASE WHEN CASE WHEN protected THEN least(r4, 25.0) WHEN rule_score = 0 AND p_host < 0.40 THEN least(r4, 39.0) ELSE r4 END >= {policy.phishing_from} THEN 'PHISHING'
        WHEN CASE WHEN protected THEN least(r4, 25.0) WHEN rule_score = 0 AND p_host < 0.40 THEN least(r4, 39.0) ELSE r4 END >= {policy.suspicious_from} THEN 'SUSPICIOUS'
        ELSE 'SAFE' END AS risk_level FROM {n}_4)"""


CONFIDENCE = """least(100.0, greatest(0.0, CASE WHEN protected THEN greatest(mean_conf, 90.0) ELSE mean_conf END))"""
CONF_CTE = """conf_terms AS (SELECT *, list_filter([abs(p_url - 0.5::DOUBLE) * 2, abs(p_host - 0.5::DOUBLE) * 2, CASE WHEN rule_score > 0 THEN rule_score / 100.0::DOUBLE END,
    CASE WHEN intel_status = 'success' AND total_engines > 0 THEN least(1.0, greatest(0.0, intel_score / 100.0::DOUBLE)) END], lambda x: x IS NOT NULL) AS terms FROM fused),
conf0 AS (SELECT *, CASE WHEN len(terms) > 0 THEN list_sum(terms) / len(terms) * 100.0::DOUBLE ELSE abs(risk_raw - 50) * 2 END AS mean_conf FROM conf_terms),
conf AS (SELECT *, """ + CONFIDENCE + """ AS confidence_raw FROM conf0)"""
FUSED = SCAN_CTE + ",\n" + fused(risk.CURRENT, "as_wired")
ASSESSED = FUSED + ",\n" + CONF_CTE
EXPLAIN_CTE = f"""messages AS (SELECT *, list_concat(list_concat(rule_reasons,
    CASE WHEN intel_status = 'success' AND (malicious > 0 OR suspicious > 0) THEN intel_reasons ELSE [] END), list_filter([
    CASE WHEN intel_status = 'success' AND malicious = 0 AND suspicious = 0 AND total_engines > 0 THEN '{risk.MSG_INTEL_CLEAN}'
         WHEN intel_status = 'error' THEN '{risk.MSG_INTEL_ERROR}' WHEN intel_status = 'disabled' THEN '{risk.MSG_INTEL_DISABLED}'
         WHEN intel_status = 'unavailable' THEN '{risk.MSG_INTEL_UNAVAILABLE}' END,
    CASE WHEN risk_level <> 'SAFE' AND p_url >= 0.8 THEN '{risk.MSG_URL_MODEL}' END,
    CASE WHEN risk_level <> 'SAFE' AND p_host >= 0.8 THEN '{risk.MSG_HOST_MODEL}' END,
    CASE WHEN risk_level = 'SAFE' AND agree AND rule_score = 0 AND NOT (enough AND (malicious >= 1 OR suspicious >= 3)) THEN '{risk.MSG_MODELS_ALONE}' END,
    CASE WHEN protected THEN '{risk.MSG_TRUSTED}' END,
    CASE WHEN intel_status = 'success' AND intel_score >= 50 THEN '{risk.MSG_INTEL_STRONG}' END], lambda x: x IS NOT NULL)) AS msgs FROM conf)"""


def first_only(listing: str) -> str:
    return f"list_filter({listing}, lambda x, j: list_position({listing}, x) = j)"


SCAN_LOG = ASSESSED + """,
log AS (SELECT e.event_id, e.ts, e.value, e.event_id % 3 = 0 AS cache_hit, c.* FROM events e
  JOIN (SELECT * FROM conf WHERE variant = 0) c ON c.page_id = e.event_id % (SELECT count(*) FROM pages))"""

REQUESTS = """requests AS (SELECT event_id, CAST(user_id AS VARCHAR) AS client, epoch_us(ts) AS at_us, p.page_id, p.url
  FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages))"""
WIDTH = 6 * 3600 * 1_000_000


def anchored(source: str, key: str) -> str:
    """Table ``windowed``: rows of ``source`` with window_start_us and position."""
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY at_us, event_id) AS rn FROM {source}),
chain AS (
  SELECT *, at_us AS window_start_us, CAST(1 AS BIGINT) AS position FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.*, CASE WHEN n.at_us >= c.window_start_us + {WIDTH} THEN n.at_us ELSE c.window_start_us END,
    CASE WHEN n.at_us >= c.window_start_us + {WIDTH} THEN 1 ELSE c.position + 1 END
  FROM chain c JOIN numbered n ON n.{key} = c.{key} AND n.rn = c.rn + 1),
windowed AS (SELECT * FROM chain)"""


PREDICTIONS = (
    f"predictions AS (SELECT page_id, url, {word32('url')} % 2 AS label, round({unit(chr(39) + 'u' + chr(39) + ' || url')}, 2) AS probability FROM pages),\n"
    "preds AS (SELECT *, CASE WHEN probability > 0.5 THEN 1 ELSE 0 END AS prediction FROM predictions)"
)
JUDGED = PREDICTIONS + (
    ",\njudged AS (SELECT url, regexp_extract(url, '^[a-z]+://[^/]*/([^/]*)/', 1) AS category, label AS expected, prediction, probability, "
    "prediction = label AS correct FROM preds)"
)
CONFUSION = (
    "confusion AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp, "
    "count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM preds)"
)


def rate(part: str, whole: str) -> str:
    return f"coalesce(({part})::DOUBLE / nullif({whole}, 0), 0.0)"


def split_case(rank: str, total: str) -> str:
    held = f"CAST(ceil({total} * 0.3::DOUBLE) AS BIGINT)"
    return (
        f"CASE WHEN {rank} <= {total} - {held} THEN 'train' "
        f"WHEN {rank} <= {total} - CAST(ceil({held} * 0.5::DOUBLE) AS BIGINT) THEN 'validation' ELSE 'test' END"
    )


STRATIFIED = PAGE_HOSTS + (
    ",\nstratified AS (SELECT page_id, url, domain, label, "
    + split_case("row_number() OVER (PARTITION BY label ORDER BY md5('42' || url))", "count(*) OVER (PARTITION BY label)")
    + " AS split FROM page_hosts)"
)


def grouped_split(key: str, source: str, name: str) -> str:
    return (
        f"{name}_keys AS (SELECT k, " + split_case("row_number() OVER (ORDER BY md5('42' || k))", "count(*) OVER ()")
        + f" AS split FROM (SELECT DISTINCT {key} AS k FROM {source})),\n"
        f"{name} AS (SELECT s.*, g.split FROM {source} s JOIN {name}_keys g ON g.k = s.{key})"
    )


GROUPED = PAGE_HOSTS + ",\n" + grouped_split("domain", "page_hosts", "grouped")


def hard(domains: str, paths, shapes, label: int, source: str, name: str) -> str:
    placed = ", ".join("'" + s.replace("{d}", "' || d || '").replace("{p}", "' || p || '") + "'" for s in shapes)
    return (
        f"{name} AS (SELECT unnest([{placed}]) AS url, CAST({label} AS INTEGER) AS label, '{source}' AS augmentation_source "
        f"FROM ({domains}) CROSS JOIN (SELECT unnest({listed(paths)}) AS p))"
    )


HARD_NEGATIVES = hard("SELECT DISTINCT domain AS d FROM page_hosts", fv.LEGITIMATE_PATHS, fv.HARD_NEGATIVE_SHAPES, 0,
                      "hard_negative_legitimate_domain", "negatives")


def hard_positives(prefix: str) -> str:
    return hard(f"SELECT DISTINCT '{prefix}-' || domain AS d FROM page_hosts", fv.PHISHING_PATHS, fv.HARD_POSITIVE_SHAPES, 1,
                "hard_positive_impersonation_domain", "positives")


# Page URLs have plain queries, so adding the marker needs no re-encoding here.
MUTATED = r"""page_parts AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+):', 1) AS sc, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS pa, regexp_extract(url, '\?([^#]*)', 1) AS q, regexp_extract(url, '#(.*)$', 1) AS f FROM pages),
tails AS (SELECT *, CASE WHEN q <> '' THEN '?' || q ELSE '' END AS qq, CASE WHEN f <> '' THEN '#' || f ELSE '' END AS ff FROM page_parts),
cand AS (SELECT page_id, url AS original_url, m.mutation, m.u AS url FROM (SELECT *, unnest([
    {'mutation': 'toggle_scheme', 'u': CASE WHEN sc = 'https' THEN 'http' ELSE 'https' END || '://' || h || pa || qq || ff},
    {'mutation': 'add_www', 'u': sc || '://' || CASE WHEN h LIKE 'www.%' THEN h ELSE 'www.' || h END || pa || qq || ff},
    {'mutation': 'remove_www', 'u': sc || '://' || regexp_replace(h, '^www\.', '') || pa || qq || ff},
    {'mutation': 'trailing_slash', 'u': sc || '://' || h || CASE WHEN pa = '' THEN '/' WHEN right(pa, 1) <> '/' THEN pa || '/' WHEN pa = '/' THEN pa ELSE rtrim(pa, '/') END || qq || ff},
    {'mutation': 'simple_query', 'u': sc || '://' || h || pa || '?' || CASE WHEN q = '' THEN 'ref=internal'
        WHEN list_contains(list_transform(string_split(q, '&'), lambda x: split_part(x, '=', 1)), 'ref') THEN q ELSE q || '&ref=internal' END || ff},
    {'mutation': 'fragment', 'u': sc || '://' || h || pa || qq || '#section'},
    {'mutation': 'safe_path', 'u': sc || '://' || h || CASE WHEN pa = '' THEN '/home' WHEN right(pa, 1) = '/' THEN pa || 'home' ELSE pa || '/home' END || qq || ff},
    {'mutation': 'remove_query', 'u': sc || '://' || h || pa || ff},
    {'mutation': 'remove_fragment', 'u': sc || '://' || h || pa || qq}]) AS m FROM tails)),
changed AS (SELECT * FROM cand WHERE url <> original_url QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY md5(original_url || mutation)) = 1),
mutated AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY md5(original_url || mutation)) AS mutation_rank FROM changed QUALIFY mutation_rank <= 2)"""


def robust(*synthetic: str) -> str:
    parts = ["SELECT url, CAST(label AS INTEGER) AS label, url AS original_url, 'original' AS augmentation_source, 0 AS stage, page_id AS o, 0 AS o2, '' AS o3 FROM page_hosts",
             "SELECT m.url, CAST(p.label AS INTEGER), original_url, 'label_preserving_mutation', 1, m.page_id, mutation_rank, '' FROM mutated m JOIN page_hosts p USING (page_id)"]
    for k, name in enumerate(synthetic):
        parts.append(f"SELECT url, label, url, augmentation_source, {k + 2}, 0, 0, url FROM {name}")
    return "staged AS (" + " UNION ALL ".join(parts) + "),\nrobust AS (SELECT url, label, original_url, augmentation_source FROM staged QUALIFY row_number() OVER (PARTITION BY url ORDER BY stage, o, o2, o3) = 1)"


ROBUST = PAGE_HOSTS + ",\n" + MUTATED + ",\n" + HARD_NEGATIVES + ",\n" + hard_positives("paypal") + ",\n" + robust("negatives", "positives")
JOBS = """changes AS (SELECT event_id, 'job-' || user_id AS scan_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing'
    WHEN 'error' THEN 'failed' ELSE 'completed' END AS status, epoch_us(ts) AS at_us FROM events),
latest AS (SELECT scan_id, arg_max(status, (at_us, event_id)) AS status, arg_max(event_id, (at_us, event_id)) AS event_id,
    max(at_us) AS updated_at_us, min(at_us) FILTER (status = 'queued') AS created_at_us FROM changes GROUP BY scan_id
    HAVING count(*) FILTER (status = 'queued') > 0)"""

# --- the checks ----------------------------------------------------------------------------------

S = ORACLE_SQL
S["read_corpus"] = "SELECT page_id, url, toxic AS label FROM pages JOIN labels ON doc_id = page_id"
S["normalize_urls"] = with_(PROBE_NORM) + (
    "SELECT page_id, variant::INTEGER AS variant, nu AS normalized_url, scheme, userinfo, host, port, path, query, fragment FROM norm"
)
S["normalize_urls_lowercased"] = with_(PROBES, "lowered AS (SELECT * REPLACE (lower(url) AS url) FROM probes)", norm("lowered")) + (
    "SELECT page_id, variant::INTEGER AS variant, nu AS normalized_url, scheme, userinfo, host, port, path, query, fragment FROM norm"
)
VALIDATED = PROBES + r""",
checked AS (SELECT page_id, variant, regexp_replace(url, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t,
    regexp_replace(url, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS url FROM probes),
coded AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN length(t) > 2048 THEN 'too_long'
    WHEN NOT regexp_matches(t, '^(https?://)?(([a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}|([0-9]{1,3}\.){3}[0-9]{1,3}|localhost)[:0-9]{0,6}([/?#].*)?$') THEN 'bad_syntax'
    WHEN coalesce(TRY_CAST(nullif(regexp_extract(t, '^(?:https?://)?[^/?#:]+:([0-9]*)', 1), '') AS INTEGER), 1) NOT BETWEEN 1 AND 65535 THEN 'bad_port'
    END AS error_code FROM checked)"""
S["validate_urls"] = with_(VALIDATED, "probes2 AS (SELECT page_id, variant, url FROM coded WHERE error_code IS NULL)", norm("probes2")) + (
    "SELECT c.page_id, c.variant::INTEGER AS variant, c.error_code, n.nu AS accepted_url FROM coded c LEFT JOIN norm n USING (page_id, variant)"
)
S["quarantine_counts"] = with_(VALIDATED) + "SELECT error_code, count(*) AS n_urls FROM coded WHERE error_code IS NOT NULL GROUP BY 1"
S["registered_domains"] = with_(PROBE_NORM) + f"SELECT {REGISTERED} AS registered_domain, count(*) AS n_urls FROM norm GROUP BY 1"
S["hostname_keys"] = with_(PROBE_NORM) + (
    "SELECT page_id, variant::INTEGER AS variant, lower(regexp_extract(regexp_replace(trim(url), '^.*?://', ''), '^(?:[^/?#]*@)?([^@/?#]*)', 1)) AS textual_host, "
    "trim(host, '.') AS parsed_host FROM norm"
)
S["url_features"] = with_(PROBE_NORM, WITH_RD) + "SELECT page_id, variant::INTEGER AS variant, " + ", ".join(feature(n) for n in fv.FEATURE_NAMES) + " FROM rd_norm"
S["rule_signals"] = with_(PROBE_NORM, SIGNALS_CTE) + "SELECT page_id, variant::INTEGER AS variant, " + ", ".join(
    f"round({n}, 6) AS {n}" if n.endswith("_entropy") and not n.startswith("high") else n for n in SIGNAL_SQL) + " FROM sig"
S["feature_schema_check"] = with_(PROBE_NORM) + (
    "SELECT true AS names_in_order, 0 AS missing_columns, count(*) AS n_rows, CAST(0 AS BIGINT) AS invalid_rows, count(*) - count(DISTINCT nu) AS repeated_urls FROM norm WHERE variant <> 13"
)
S["drop_invalid_urls"] = with_(PROBES) + (
    "SELECT page_id, variant::INTEGER AS variant, trim(CASE WHEN variant = 10 THEN 'NaN' ELSE url END) AS url FROM probes WHERE variant NOT IN (10, 11)"
)
S["coerce_label"] = "SELECT page_id, CASE page_id % 7 WHEN 1 THEN 0 ELSE 1 END AS label FROM pages WHERE page_id % 7 IN (0, 1, 2)"
S["clean_feature_table"] = """WITH raw AS (SELECT DISTINCT CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'Infinity' ELSE value::VARCHAR END AS a,
  CASE WHEN event_id % 5 <> 0 THEN json_extract_string(props, '$.k') END AS k, user_id, CASE WHEN event_id % 13 = 0 THEN 'bad' ELSE (event_id % 2)::VARCHAR END AS label FROM events),
num AS (SELECT CASE WHEN a <> 'Infinity' THEN a::DOUBLE END AS amount_due, k::DOUBLE AS k, user_id::DOUBLE AS user_id, label::INTEGER AS label FROM raw WHERE label <> 'bad')
SELECT label, round(coalesce(amount_due, (SELECT median(amount_due) FROM num)), 6) AS amount_due, round(coalesce(k, (SELECT median(k) FROM num)), 6) AS k,
  CAST(7.0 AS DOUBLE) AS fixed, round(user_id, 6) AS user_id FROM num"""
S["constant_features"] = with_("probes AS (SELECT page_id, 0 AS variant, url FROM pages)", norm("probes"), FEATURES_CTE) + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, count(DISTINCT {n}) <= 1 AS constant FROM feats" for n in fv.FEATURE_NAMES)
S["select_features"] = with_(PROBE_NORM, WITH_RD) + "SELECT " + ", ".join(
    feature(n) for n in fv.FEATURE_NAMES if n not in ("has_https", "path_length", "slash_count")) + " FROM rd_norm WHERE variant <> 13"

S["enrich_threat_intel"] = with_(PROBES, reports(False)) + (
    "SELECT page_id, variant::INTEGER AS variant, intel_status, malicious, suspicious, harmless, undetected, total_engines, intel_score, array_to_string(intel_reasons, ' | ') AS intel_reasons "
    f"FROM (SELECT p.page_id, p.variant, {INTEL_COLUMNS} FROM probes p LEFT JOIN reports r ON r.url = p.page_url)"
)
UPDATES = """updates AS (
  SELECT event_id AS update_id, p.url, epoch_us(ts) AS at_us, CASE event_type WHEN 'click' THEN 'in-progress' WHEN 'error' THEN 'error'
    WHEN 'signup' THEN 'queued' ELSE 'completed' END AS state, CAST(floor(value * 10) AS INTEGER) AS tenths
  FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages) WHERE event_id % 3 <> 0)"""
SEEN = """asked AS (SELECT event_id, user_id, p.page_id, p.url, epoch_us(ts) AS ts_us FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)
  WHERE event_id % 3 = 0),
ranked AS (SELECT a.*, u.*, row_number() OVER (PARTITION BY event_id ORDER BY state = 'completed' DESC, at_us DESC, update_id DESC) AS k
  FROM asked a LEFT JOIN updates u ON lower(trim(u.url)) = lower(trim(a.url)) AND user_id <> 7 AND at_us > ts_us - 345600000000 AND at_us <= ts_us + 21600000000),
counts AS (SELECT event_id, page_id, user_id, update_id, state, (CASE WHEN state IS NULL OR state = 'error' THEN 0 ELSE 1 END) AS live,
    live * coalesce(tenths % 4, 0) AS malicious, live * coalesce(tenths % 3, 0) AS suspicious, live * coalesce(tenths % 7, 0) AS harmless,
    live * coalesce(tenths % 5, 0) AS undetected FROM ranked WHERE k = 1),
totalled AS (SELECT *, malicious + suspicious + harmless + undetected AS total_engines, CASE WHEN malicious + suspicious + harmless + undetected > 0
    THEN round(least((malicious + suspicious * 0.5::DOUBLE) * 100.0::DOUBLE / (malicious + suspicious + harmless + undetected), 100.0), 2) ELSE 0.0 END AS intel_score FROM counts),
seen AS (SELECT event_id, page_id, update_id AS intel_seen_id, CASE WHEN user_id = 7 THEN 'disabled' WHEN state IS NULL THEN 'unavailable'
  WHEN state = 'completed' THEN 'success' ELSE state END AS intel_status, malicious, suspicious, harmless, undetected, total_engines,
  intel_score, CASE WHEN live = 0 THEN [] ELSE """ + report_reasons("state", "intel_score") + """ END AS intel_reasons FROM totalled)"""
S["reports_seen"] = with_(UPDATES, SEEN) + "SELECT * EXCLUDE (page_id) REPLACE (array_to_string(intel_reasons, ' | ') AS intel_reasons) FROM seen"
S["flag_trusted"] = with_(PROBE_NORM) + "SELECT page_id, variant::INTEGER AS variant, (" + " OR ".join(
    f"host = '{d}' OR host LIKE '%.{d}'" for d in fv.TRUSTED_DOMAINS) + ") AS trusted_domain FROM norm"
S["flag_trusted_by_table"] = with_(PROBE_NORM) + (
    "SELECT n.page_id, n.variant::INTEGER AS variant, EXISTS (SELECT 1 FROM norm d WHERE d.page_id % 3 = 0 AND d.variant = 0 "
    "AND (n.host = d.host OR n.host LIKE '%.' || d.host)) AS trusted_domain FROM norm n"
)
S["brand_impersonation"] = with_(PROBE_NORM, WITH_RD) + (
    f"SELECT page_id, variant::INTEGER AS variant, array_to_string({BRAND_HITS}, ' | ') AS brand_matches, len({BRAND_HITS}) > 0 AS brand_impersonation FROM rd_norm"
)
S["suspicious_tld"] = with_(PROBE_NORM, WITH_RD) + (
    f"SELECT page_id, variant::INTEGER AS variant, {TLD.format('rd')} IN ({quoted(fv.FEATURE_TLDS)}) AS feature_tld, {TLD.format('host')} IN ({quoted(fv.RULE_TLDS)}) AS rule_tld FROM rd_norm"
)
S["suspicious_words"] = with_(PROBE_NORM) + (
    f"SELECT page_id, variant::INTEGER AS variant, CAST({FEATURE_WORD_COUNT} AS INTEGER) AS feature_words, CAST({RULE_WORD_COUNT} AS INTEGER) AS rule_words FROM norm"
)
LISTED = f"""listed AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS name FROM documents
  UNION SELECT unnest({listed([*fv.BRAND_DOMAINS, *fv.FEATURE_WORDS, *fv.RULE_WORDS])}))"""
S["brand_impersonation_by_table"] = with_(
    PROBE_NORM, WITH_RD, LISTED,
    "own AS (SELECT DISTINCT split_part(host, '.', 1) AS brand, rd AS domain FROM rd_norm WHERE variant = 0)",
    "owned AS (SELECT * FROM own UNION SELECT * FROM (VALUES " + ", ".join(f"('{b}', '{d}')" for b, ds in fv.BRAND_DOMAINS.items() for d in ds) + ") v(brand, domain))",
    "brands AS (SELECT name AS brand FROM listed UNION SELECT brand FROM own)",
    "all_hosts AS (SELECT DISTINCT trim(host, '.') AS h, rd FROM rd_norm WHERE host <> '')",
    """found AS (SELECT h, array_to_string(list_sort(list(brand)), ' | ') AS names FROM all_hosts a JOIN brands b ON contains(a.h, b.brand) AND b.brand <> ''
  WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.brand = b.brand AND o.domain = a.rd) GROUP BY h)""",
) + """SELECT page_id, variant::INTEGER AS variant, coalesce(names, '') AS brand_matches, names IS NOT NULL AS brand_impersonation
  FROM rd_norm LEFT JOIN found ON h = trim(host, '.')"""
S["suspicious_words_by_table"] = with_(
    PROBE_NORM, LISTED, "texts AS (SELECT DISTINCT lower(nu) AS u FROM norm)",
    "f AS (SELECT u, count(DISTINCT name) AS n FROM (SELECT u, unnest(regexp_split_to_array(u, '[^a-z0-9]+')) AS w FROM texts) JOIN listed ON name = w GROUP BY u)",
    r"r AS (SELECT u, count(*) AS n FROM (SELECT u, unnest(regexp_split_to_array(u, '[^\p{L}\p{N}_]+')) AS w FROM texts) JOIN listed ON name = w GROUP BY u)",
) + r"""SELECT page_id, variant::INTEGER AS variant, CAST(coalesce(f.n, 0) + CASE WHEN regexp_matches(lower(nu), '(^|[^a-z0-9])sign-in([^a-z0-9]|$)') THEN 1 ELSE 0 END AS INTEGER) AS feature_words,
  CAST(coalesce(r.n, 0) + len(regexp_extract_all(lower(nu), '\bsign-in\b')) AS INTEGER) AS rule_words
  FROM norm LEFT JOIN f ON f.u = lower(nu) LEFT JOIN r ON r.u = lower(nu)"""
S["combine_model_scores"] = f"""WITH s AS (SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN {unit("'u' || url")} END AS p_url, CASE WHEN page_id % 4 <> 0 THEN {unit("'h' || url")} END AS p_host FROM pages)
SELECT page_id, round(p_url, 6) AS p_url, round(p_host, 6) AS p_host, round(CASE WHEN p_url IS NOT NULL AND p_host IS NOT NULL THEN p_url * 35 + p_host * 65 ELSE coalesce(p_host, p_url, 0) * 100 END, 6) AS model_score FROM s"""
S["cache_lookup"] = with_(REQUESTS, "stored_asks AS (SELECT * FROM requests WHERE event_id % 2 = 0)", anchored("stored_asks", "url")) + (
    f"SELECT q.event_id, w.window_start_us IS NOT NULL AS cache_hit, w.window_start_us AS cached_from_us FROM requests q LEFT JOIN (SELECT * FROM windowed WHERE position = 1) w "
    f"ON w.url = q.url AND q.at_us >= w.window_start_us AND q.at_us < w.window_start_us + {WIDTH} WHERE q.event_id % 2 = 1"
)
S["score_cases"] = with_(PREDICTIONS) + "SELECT url, label::INTEGER AS expected, prediction, prediction = label AS correct, round(probability, 6) AS probability FROM preds WHERE page_id % 5 <> 0"
S["job_status"] = with_(JOBS, "ids AS (SELECT 'job-' || c_custkey AS scan_id FROM customer UNION ALL SELECT 'job ' || page_id FROM pages)") + (
    "SELECT i.scan_id, CASE WHEN NOT regexp_full_match(i.scan_id, '[A-Za-z0-9_-]{1,128}') THEN 'invalid' ELSE coalesce(l.status, 'not_found') END AS status FROM ids i LEFT JOIN latest l USING (scan_id)"
)
S["split_membership_overlap"] = with_(STRATIFIED) + "SELECT domain FROM stratified WHERE split = 'train' INTERSECT SELECT domain FROM stratified WHERE split = 'test'"

S["scan_stats"] = with_(SCAN_LOG) + "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (risk_level = '{v}') AS {v.lower()}" for v in ("SAFE", "SUSPICIOUS", "PHISHING")) + " FROM log"
S["label_distribution"] = with_(GROUPED) + "SELECT split, label::INTEGER AS label, count(*) AS n_rows, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY split), 4) AS share FROM grouped GROUP BY split, label"
S["augmentation_distribution"] = with_(ROBUST) + "SELECT augmentation_source, count(*) AS n_rows FROM robust GROUP BY 1"
PER_HOST = "per_host AS (SELECT domain, min(label) AS lo, max(label) AS hi, count(*) AS n FROM page_hosts GROUP BY domain)"
S["domain_label_profile"] = with_(PAGE_HOSTS, PER_HOST) + (
    "SELECT CASE WHEN lo = 1 AND hi = 1 THEN 'phishing_only' WHEN lo = 0 AND hi = 0 THEN 'legitimate_only' ELSE 'mixed' END AS kind, count(*) AS n_domains, CAST(sum(n) AS BIGINT) AS n_urls FROM per_host GROUP BY 1"
)
S["top_domains"] = with_(PAGE_HOSTS, PER_HOST) + "SELECT domain, n AS n_urls FROM per_host ORDER BY n DESC, domain LIMIT 20"
S["domain_concentration"] = with_(PAGE_HOSTS, PER_HOST, "ordered AS (SELECT n, row_number() OVER (ORDER BY n DESC, domain) AS rn FROM per_host)",
    f"cuts AS (SELECT percent, greatest(1, CAST(floor((SELECT count(*) FROM per_host) * percent / 100) AS BIGINT)) AS top_domains FROM (SELECT unnest([{', '.join(map(str, CONCENTRATION_PERCENTS))}]::DOUBLE[]) AS percent))") + (
    "SELECT percent, top_domains, CAST(sum(n) AS BIGINT) AS top_urls, round(sum(n) * 100.0::DOUBLE / (SELECT count(*) FROM pages), 2) AS share_percent FROM cuts JOIN ordered ON rn <= top_domains GROUP BY 1, 2"
)
S["mixed_domain_ratio"] = with_(PAGE_HOSTS, PER_HOST) + (
    "SELECT count(*) FILTER (lo <> hi) AS mixed_domains, count(*) AS n_domains, round(count(*) FILTER (lo <> hi) * 100.0::DOUBLE / count(*), 2) AS mixed_percent FROM per_host"
)
S["feature_profile"] = with_(PROBE_NORM, FEATURES_CTE) + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, round(min({n})::DOUBLE, 6) AS min, round(avg({n}), 6) AS mean, round(median({n})::DOUBLE, 6) AS median, round(max({n})::DOUBLE, 6) AS max, "
    + (f"count(DISTINCT {n}) AS n_distinct" if not n.endswith("_entropy") else f"count(DISTINCT round({n}, 9)) AS n_distinct")
    + f", CAST(0 AS BIGINT) AS n_missing, count(DISTINCT {n}) <= 1 AS constant FROM feats" for n in fv.FEATURE_NAMES)
S["duplicate_audit"] = with_(PAGE_HOSTS, "doubled AS (SELECT * FROM page_hosts UNION ALL SELECT * FROM page_hosts WHERE page_id % 3 = 0)") + (
    "SELECT count(*) AS n_rows, count(*) - count(DISTINCT url) AS repeated_urls, count(*) - count(DISTINCT domain) AS repeated_domains FROM doubled"
)
S["threat_report_from_verdicts"] = with_(reports(True)) + (
    f"SELECT url, 'success' AS status, malicious, suspicious, harmless, undetected, \"timeout\", total_engines, threat_score, array_to_string({report_reasons()}, ' | ') AS reasons FROM reports"
)
BASIC = {
    "accuracy": rate("tp + tn", "tp + fp + tn + fn"), "precision": rate("tp", "tp + fp"), "recall": rate("tp", "tp + fn"),
    "f1": rate("2 * tp", "2 * tp + fp + fn"),
}
S["binary_metrics"] = with_(PREDICTIONS, CONFUSION) + "SELECT tp, fp, tn, fn, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in BASIC.items()) + " FROM confusion"
S["roc_auc"] = with_(PREDICTIONS) + """SELECT (SELECT count(*) FROM preds WHERE label = 1) AS n_pos, (SELECT count(*) FROM preds WHERE label = 0) AS n_neg,
  round(avg(CASE WHEN a.probability > b.probability THEN 1.0 WHEN a.probability = b.probability THEN 0.5 ELSE 0.0 END), 6) AS roc_auc
FROM preds a JOIN preds b ON a.label = 1 AND b.label = 0"""
S["average_precision"] = with_(PREDICTIONS, "per AS (SELECT probability, sum(label) AS pos, count(*) AS n FROM preds GROUP BY 1)",
    "cum AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM per WINDOW w AS (ORDER BY probability DESC))") + (
    "SELECT CAST(sum(pos) AS BIGINT) AS n_pos, round(sum(pos * tp::DOUBLE / seen) / sum(pos), 6) AS average_precision FROM cum"
)
S["classification_report"] = with_(PREDICTIONS, CONFUSION, f"""classes AS (
  SELECT 'Legitimate' AS class_name, {rate('tn', 'tn + fn')} AS p, {rate('tn', 'tn + fp')} AS r, {rate('2 * tn', '2 * tn + fn + fp')} AS f, tn + fp AS s FROM confusion
  UNION ALL SELECT 'Phishing', {rate('tp', 'tp + fp')}, {rate('tp', 'tp + fn')}, {rate('2 * tp', '2 * tp + fp + fn')}, tp + fn FROM confusion)""") + (
    "SELECT class_name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s AS support FROM classes "
    f"UNION ALL SELECT 'accuracy', round({BASIC['accuracy']}, 6), round({BASIC['accuracy']}, 6), round({BASIC['accuracy']}, 6), tp + fp + tn + fn FROM confusion "
    "UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(s) AS BIGINT) FROM classes "
    "UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM classes"
)
_BY_LABEL = """by_label AS (SELECT c AS label, count(*) FILTER (label = c AND prediction = c) AS hits, count(*) FILTER (prediction = c) AS guessed,
    count(*) FILTER (label = c) AS support FROM preds CROSS JOIN (VALUES (0), (1)) AS v(c) GROUP BY c),
rates AS (SELECT label, support, coalesce(hits::DOUBLE / nullif(guessed, 0), 0.0) AS p, coalesce(hits::DOUBLE / nullif(support, 0), 0.0) AS r,
    coalesce(2.0::DOUBLE * hits / nullif(guessed + support, 0), 0.0) AS f, hits FROM by_label),
report AS (SELECT label, 'class' AS class_name, p, r, f, support FROM rates
  UNION ALL SELECT NULL, 'accuracy', sum(hits)::DOUBLE / sum(support), sum(hits)::DOUBLE / sum(support), sum(hits)::DOUBLE / sum(support), sum(support)::BIGINT FROM rates
  UNION ALL SELECT NULL, 'macro avg', avg(p), avg(r), avg(f), sum(support)::BIGINT FROM rates
  UNION ALL SELECT NULL, 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support)::BIGINT FROM rates)"""
S["classification_report_by_polarity"] = with_(PREDICTIONS, _BY_LABEL) + """SELECT positive_label,
    CASE WHEN label IS NULL THEN class_name WHEN label = positive_label THEN 'Phishing' ELSE 'Legitimate' END AS class_name,
    round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM report CROSS JOIN (VALUES (0), (1)) AS v(positive_label)"""
S["category_summary"] = with_(JUDGED) + (
    "SELECT coalesce(category, 'ALL') AS category, count(*) FILTER (correct) AS correct, count(*) AS total, round(avg(correct::INTEGER), 6) AS accuracy, round(avg(probability), 6) AS mean_probability, "
    "count(*) FILTER (prediction = 1) AS predicted_phishing, count(*) FILTER (prediction = 0) AS predicted_legitimate FROM judged GROUP BY ROLLUP (category)"
)
S["category_prediction_matrix"] = with_(JUDGED) + (
    "SELECT category, count(*) FILTER (prediction = 0) AS \"LEGITIMATE\", count(*) FILTER (prediction = 1) AS \"PHISHING\", round(avg(probability), 6) AS mean_probability FROM judged GROUP BY category"
)
S["ngram_document_frequency"] = """WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages),
g AS (SELECT page_id, substr(host, s, n) AS gram FROM h CROSS JOIN (SELECT unnest([2, 3, 4, 5]) AS n) CROSS JOIN (SELECT unnest(range(1, 300)) AS s) WHERE s + n - 1 <= length(host))
SELECT gram, count(DISTINCT page_id) AS n_documents, count(*) AS n_terms FROM g GROUP BY gram HAVING count(DISTINCT page_id) >= 3"""
S["domains_per_split"] = with_(STRATIFIED) + "SELECT split, count(DISTINCT domain) AS n_domains FROM stratified GROUP BY split"

S["recent_scans"] = with_(SCAN_LOG) + "SELECT event_id AS id, nu AS url, risk_level AS prediction, round(round(risk_raw, 2), 6) AS risk_score, epoch_us(ts) AS scanned_at_us FROM log ORDER BY ts DESC, event_id DESC LIMIT 100"
S["history_rows"] = with_(SCAN_LOG) + f"""SELECT event_id AS id, nu AS url, risk_level AS prediction, round(risk_raw, 2) AS risk_score, risk_level, round(confidence_raw, 2) AS confidence, trusted_domain,
  round(p_url * 100, 6) AS url_ml_score, round(p_host * 100, 6) AS hostname_ml_score, round(model_score, 6) AS model_score, rule_score::DOUBLE AS rule_score, intel_score AS threat_score,
  malicious AS vt_malicious, suspicious AS vt_suspicious, harmless AS vt_harmless, undetected AS vt_undetected, total_engines AS vt_total_engines, intel_status AS threat_intel_status,
  '{intel.PROVIDER}' AS threat_intel_provider, CASE WHEN cache_hit THEN 0.0 ELSE round(value, 6) END AS scan_duration_ms, epoch_us(ts) AS scanned_at_us FROM log"""
S["keep_first"] = with_(REQUESTS) + "SELECT event_id, client, url FROM requests QUALIFY row_number() OVER (PARTITION BY url ORDER BY event_id) = 1"
S["mutate_urls"] = with_(MUTATED) + "SELECT page_id, original_url, url, mutation, mutation_rank::INTEGER AS mutation_rank FROM mutated"
RESULTS = f"""guesses AS (SELECT s, m, {word32('url')} % 2 AS label, CASE WHEN {unit('m || s || url')} > 0.5 THEN 1 ELSE 0 END AS prediction FROM pages
  CROSS JOIN (SELECT unnest(['a', 'b', 'c']) AS m) CROSS JOIN (SELECT unnest(['all', 'few', 'one', 'two']) AS s)),
cells AS (SELECT s, m, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM guesses GROUP BY s, m),
results AS (SELECT s AS feature_set, m AS model, {BASIC['precision']} AS precision, {BASIC['recall']} AS recall, {BASIC['f1']} AS f1 FROM cells)"""
S["model_comparison"] = with_(RESULTS) + "SELECT model, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, row_number() OVER (ORDER BY f1 DESC, model DESC) = 1 AS selected FROM results WHERE feature_set = 'all'"
S["best_configurations"] = with_(RESULTS) + "SELECT feature_set, model, round(f1, 6) AS f1 FROM results ORDER BY results.f1 DESC, feature_set, model LIMIT 10"
S["failure_analysis"] = with_(JUDGED) + (
    "SELECT category, url, CASE WHEN expected = 1 THEN 'PHISHING' ELSE 'LEGITIMATE' END AS expected_label, CASE WHEN prediction = 1 THEN 'PHISHING' ELSE 'LEGITIMATE' END AS predicted_label, "
    "round(probability, 6) AS probability FROM judged WHERE NOT correct"
)
S["deterministic_shuffle"] = "SELECT page_id, url, md5('42' || url) AS shuffle_key FROM pages"

DEDUP_ROWS = PROBES + """,
asked AS (SELECT page_id, variant::INTEGER AS variant, url FROM probes WHERE variant IN (0, 4, 6, 14)),
rows_ AS (SELECT * FROM asked UNION ALL SELECT page_id, variant + 100, upper(url) || '/' FROM asked)"""


def kept(policy: str, key: str, source: str = "rows_") -> str:
    return (
        f"SELECT '{policy}' AS policy, page_id, variant::INTEGER AS variant, url FROM (SELECT *, {key} AS k FROM {source}) WHERE k <> '' "
        "QUALIFY row_number() OVER (PARTITION BY k ORDER BY page_id, variant) = 1"
    )


S["dedup_urls"] = with_(DEDUP_ROWS, norm("rows_")) + " UNION ALL ".join(f"({q})" for q in (
    kept("lower_trim", "lower(trim(url))"), kept("lower_trim_no_trailing_slash", "regexp_replace(lower(trim(url)), '/$', '')"),
    kept("trim_add_http", "CASE WHEN starts_with(trim(url), 'http://') OR starts_with(trim(url), 'https://') THEN trim(url) ELSE 'http://' || trim(url) END"),
    kept("normalized", "nu", "norm"), kept("full_row", "url"),
))
S["staged_union"] = with_(ROBUST) + "SELECT * FROM robust"
S["union_for_refit"] = with_(STRATIFIED) + "SELECT page_id, url, label::INTEGER AS label, split FROM stratified WHERE split IN ('train', 'validation')"
OVERLAP_PAIRS = [("train", "validation"), ("train", "test"), ("validation", "test")]


def overlaps(kind: str, table: str, key: str) -> list[str]:
    return [
        f"SELECT '{kind}' AS kind, '{a}' AS left_split, '{b}' AS right_split, (SELECT count(*) FROM (SELECT {key} FROM {table} WHERE split = '{a}' INTERSECT SELECT {key} FROM {table} WHERE split = '{b}')) AS shared"
        for a, b in OVERLAP_PAIRS
    ]


S["cross_split_overlap"] = with_(
    STRATIFIED, "registered_hosts AS (SELECT *, array_to_string(string_split(domain, '.')[-2:], '.') AS registered FROM page_hosts)",
    grouped_split("registered", "registered_hosts", "by_registered"),
) + " UNION ALL ".join(overlaps("stratified/host", "stratified", "domain") + overlaps("stratified/url", "stratified", "url") + overlaps("grouped/registered", "by_registered", "registered"))
S["dedup_reasons"] = with_(PROBES, "parts AS (SELECT page_id, variant, regexp_split_to_array(url || '/' || url, '[/.]') AS p FROM probes)") + (
    f"SELECT page_id, variant::INTEGER AS variant, array_to_string({first_only('p')}, ' | ') AS unique_parts FROM parts"
)
S["stratified_split"] = with_(STRATIFIED) + "SELECT page_id, label::INTEGER AS label, split FROM stratified"
S["group_split"] = with_(GROUPED) + "SELECT page_id, domain, split FROM grouped"
S["hashed_group_split"] = with_(PAGE_HOSTS) + (
    f"SELECT page_id, domain, CASE WHEN {word32(chr(39) + '42' + chr(39) + ' || domain')} < {int(0.7 * 2**32)} THEN 'train' WHEN {word32(chr(39) + '42' + chr(39) + ' || domain')} < {int(0.85 * 2**32)} THEN 'validation' ELSE 'test' END AS split FROM page_hosts"
)
S["hard_negatives"] = with_(PAGE_HOSTS, HARD_NEGATIVES) + "SELECT * FROM negatives"
S["hard_positives"] = with_(PAGE_HOSTS, hard_positives("google")) + "SELECT * FROM positives"
S["robust_split"] = with_(PAGE_HOSTS, MUTATED, HARD_NEGATIVES, robust("negatives")) + (
    "SELECT url, label, original_url, augmentation_source, CAST(length(url) AS INTEGER) AS url_length, "
    f"CAST({non_empty(chr(40) + 'regexp_extract(url, ' + chr(39) + '^[a-z]+://[^/?#]*([^?#]*)' + chr(39) + ', 1)' + chr(41), '/')} AS INTEGER) AS path_depth, round({entropy('url')}, 6) AS url_entropy FROM robust"
)

S["rate_limit"] = with_(REQUESTS, anchored("requests", "client")) + (
    f"SELECT event_id, client, window_start_us, position, position <= 3 AS allowed, greatest(3 - position, 0) AS remaining, CAST(ceil((window_start_us + {WIDTH} - at_us) / 1000000.0) AS BIGINT) AS reset_after FROM windowed"
)
S["ttl_cache_events"] = with_(REQUESTS, anchored("requests", "url")) + (
    f"SELECT event_id, url, position > 1 AS cache_hit, window_start_us AS cached_from_us, window_start_us + {WIDTH} AS cached_until_us FROM windowed"
)
S["job_latest"] = with_(JOBS) + "SELECT scan_id, status, event_id, updated_at_us, created_at_us FROM latest"
LIVES = """ordered AS (SELECT *, lag(at_us) OVER (PARTITION BY scan_id ORDER BY at_us, event_id) AS prev FROM changes),
lives AS (SELECT *, sum(CASE WHEN prev IS NULL OR at_us - prev >= 345600000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY scan_id ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS life FROM ordered),
states AS (SELECT *, max(CASE WHEN status = 'queued' THEN at_us END)
    OVER (PARTITION BY scan_id, life ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS created_at_us FROM lives),
held AS (SELECT *, at_us + 345600000000 AS expires_at_us FROM states WHERE created_at_us IS NOT NULL)"""
S["job_states"] = with_(JOBS, LIVES) + """SELECT event_id, scan_id, status, at_us, created_at_us IS NOT NULL AS accepted, created_at_us,
    CASE WHEN created_at_us IS NOT NULL THEN at_us + 345600000000 END AS expires_at_us FROM states"""
S["job_latest_alive"] = with_(JOBS, LIVES) + """SELECT scan_id, status, event_id, at_us, created_at_us, expires_at_us FROM (
    SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY at_us DESC, event_id DESC) AS place FROM held
    WHERE at_us <= epoch_us(TIMESTAMP '2024-01-20 12:00:00')) WHERE place = 1 AND expires_at_us > epoch_us(TIMESTAMP '2024-01-20 12:00:00')"""
S["job_status_at"] = with_(JOBS, LIVES, """ids AS (SELECT 'job-' || c_custkey AS scan_id FROM customer UNION ALL SELECT 'job ' || page_id FROM pages),
polls AS (SELECT scan_id, epoch_us(unnest([TIMESTAMP '2024-01-08 00:00:00', TIMESTAMP '2024-01-15 12:00:00'])) AS polled_at_us FROM ids
    UNION ALL SELECT scan_id, at_us FROM changes),
asked AS (SELECT DISTINCT scan_id, polled_at_us FROM polls),
seen AS (SELECT a.scan_id, polled_at_us, arg_max(status, (at_us, event_id)) AS status, max(at_us) AS seen_us FROM asked a
    JOIN held h ON h.scan_id = a.scan_id AND at_us <= polled_at_us AND polled_at_us < expires_at_us GROUP BY ALL)""") + """
SELECT p.scan_id, p.polled_at_us, CASE WHEN NOT regexp_full_match(p.scan_id, '[A-Za-z0-9_-]{1,128}') THEN 'invalid' ELSE coalesce(s.status, 'not_found') END AS status, s.seen_us
FROM polls p LEFT JOIN seen s ON p.scan_id = s.scan_id AND p.polled_at_us = s.polled_at_us"""
S["job_expiry"] = with_(JOBS, "times AS (SELECT DISTINCT scan_id, at_us FROM changes)",
    "gaps AS (SELECT *, at_us - lag(at_us) OVER (PARTITION BY scan_id ORDER BY at_us) AS gap_us FROM times)") + (
    "SELECT scan_id, at_us, gap_us, coalesce(gap_us >= 3600000000, false) AS expired_before FROM gaps"
)

S["rule_score"] = with_(PROBE_NORM, SCORED_CTE) + f"SELECT page_id, variant::INTEGER AS variant, rule_score, {RULE_LEVEL} AS rule_level, array_to_string(rule_reasons, ' | ') AS rule_reasons FROM ruled"
FUSED_COLUMNS = "SELECT page_id, variant::INTEGER AS variant, round(model_score, 6) AS model_score, round(risk_raw, 6) AS risk_raw, risk_level, trusted_domain FROM fused"
S["fuse_risk"] = with_(FUSED) + FUSED_COLUMNS
S["fuse_risk_intended"] = with_(SCAN_CTE, fused(risk.CURRENT, "intended")) + FUSED_COLUMNS
S["fuse_risk_earlier_policy"] = with_(SCAN_CTE, fused(risk.EARLIER, "intended")) + FUSED_COLUMNS
S["confidence"] = with_(ASSESSED) + "SELECT page_id, variant::INTEGER AS variant, round(confidence_raw, 6) AS confidence_raw FROM conf"
S["explain_risk"] = with_(ASSESSED, EXPLAIN_CTE) + f"SELECT page_id, variant::INTEGER AS variant, array_to_string({first_only('msgs')}, ' | ') AS reasons FROM messages"
S["threat_reasons"] = with_(reports(False), "r AS (SELECT *, CASE WHEN length(url) % 3 = 0 THEN 'queued' ELSE 'completed' END AS st FROM reports)") + (
    f"SELECT url, array_to_string({report_reasons('st')}, ' | ') AS reasons FROM r"
)
S["policy_backtest"] = with_(SCAN_CTE, fused(risk.CURRENT, "as_wired", name="after_"), fused(risk.EARLIER, "as_wired", name="before_")) + (
    "SELECT b.risk_level AS before_level, a.risk_level AS after_level, count(*) AS n_urls, round(avg(a.risk_raw - b.risk_raw), 6) AS mean_shift FROM after_ a JOIN before_ b USING (page_id, variant) GROUP BY 1, 2"
)
_MODEL = """p_{0} IS NOT NULL AS {1}_available, CAST(p_{0} > 0.5 AS INTEGER) AS {1}_prediction, round(p_{0}, 6) AS {1}_probability, round(p_{0} * 100.0, 4) AS {1}_score"""
S["serialize_scan"] = with_(ASSESSED, EXPLAIN_CTE) + f"""SELECT nu AS url, TRUE AS success, nu AS response_url, round(risk_raw, 2) AS risk_score, risk_level,
  round(confidence_raw, 2) AS confidence, risk_level AS prediction, trusted_domain, array_to_string({first_only('msgs')}, ' | ') AS reasons,
  {_MODEL.format('url', 'url')}, {_MODEL.format('host', 'host')}, round(model_score, 2) AS fusion_score, rule_score::DOUBLE AS rule_score,
  '{intel.PROVIDER}' AS provider, intel_status AS status, malicious, suspicious, harmless, undetected, total_engines, intel_score AS threat_score,
  array_to_string(intel_reasons, ' | ') AS threat_reasons, CASE WHEN (page_id + variant) % 3 = 0 THEN 0.0 ELSE page_id * 0.5::DOUBLE END AS scan_duration_ms,
  (page_id + variant) % 3 = 0 AS cache_hit, CASE WHEN (page_id + variant) % 3 = 0 THEN 'cache' ELSE 'risk_engine' END AS cache_source FROM messages"""
_SCANNED = (VALIDATED + ",\nprobes2 AS (SELECT page_id, variant, NULL AS page_url, url FROM coded WHERE error_code IS NULL),\n" + norm("probes2"), SCORED_CTE)
_URL_SUM = "-2.5 + url_length * 0.01 + dot_count * 0.3 + digit_ratio * 4.0 + suspicious_words_f * 0.9 + has_suspicious_tld * 1.5 - has_https * 0.4"
_HOST_SUM = "-2.0 + hostname_length * 0.02 + hostname_entropy * 0.5 + subdomains_f * 0.2 + is_ip_f * 2.0"
_SCAN_FEATURES = "scan_features AS (SELECT page_id, variant, " + ", ".join(
    f"({FEATURE_SQL[f]})::DOUBLE AS {n}" for f, n in (
        ("url_length", "url_length"), ("dot_count", "dot_count"), ("digit_ratio", "digit_ratio"), ("suspicious_word_count", "suspicious_words_f"),
        ("has_suspicious_tld", "has_suspicious_tld"), ("has_https", "has_https"), ("hostname_length", "hostname_length"),
        ("hostname_entropy", "hostname_entropy"), ("subdomain_count", "subdomains_f"), ("is_ip_address", "is_ip_f"))) + " FROM rd_norm)"
S["scan_with_reports"] = with_(
    *_SCANNED, _SCAN_FEATURES, UPDATES, SEEN,
    f"chances AS (SELECT page_id, variant, 1 / (1 + exp(-({_URL_SUM})::DOUBLE)) AS p_url, 1 / (1 + exp(-({_HOST_SUM})::DOUBLE)) AS p_host FROM scan_features)",
    """scan AS (SELECT s.* EXCLUDE (page_id), r.* EXCLUDE (variant), c.p_url, c.p_host FROM seen s
  JOIN ruled r ON r.page_id = s.page_id AND r.variant = (s.event_id // (SELECT count(*) FROM pages)) % 16
  JOIN chances c ON c.page_id = r.page_id AND c.variant = r.variant)""",
    fused(risk.CURRENT, "as_wired"), CONF_CTE, EXPLAIN_CTE,
) + f"""SELECT event_id, intel_seen_id, intel_status, round(p_url, 6) AS p_url, round(p_host, 6) AS p_host, rule_score, round(model_score, 6) AS model_score,
  round(risk_raw, 6) AS risk_raw, risk_level, round(confidence_raw, 6) AS confidence_raw, array_to_string({first_only('msgs')}, ' | ') AS reasons FROM messages"""
S["risk_by_domain"] = with_(FUSED) + "SELECT rd AS registered_domain, risk_level, count(*) AS n_urls, round(avg(risk_raw), 6) AS mean_risk FROM fused GROUP BY 1, 2"

# --- models: what must hold whatever the fit; rows, ids and counts come from the tables --------------------------------
_PART = "CASE WHEN CAST('0x' || substr(md5('42' || host), 1, 8) AS BIGINT) < 3006477107 THEN 'train' WHEN CAST('0x' || substr(md5('42' || host), 1, 8) AS BIGINT) < 3650722201 THEN 'validation' ELSE 'test' END"
_PARTS = f"parts AS (SELECT page_id, variant, nu AS url, (variant IN (1, 2, 3, 5, 7, 8, 14, 15))::INTEGER AS label, {_PART} AS part FROM norm WHERE variant <> 13)"
for _name in ("train_logreg", "train_forest", "train_boosted"):
    S[_name] = with_(PROBE_NORM, _PARTS) + """SELECT url, label, TRUE AS available, TRUE AS in_range, TRUE AS score_agrees,
    TRUE AS class_agrees, TRUE AS auc_reached FROM parts WHERE part = 'validation'"""
S["train_hostname_model"] = with_(PROBE_NORM, _PARTS) + r"""SELECT url, label,
    split_part(regexp_extract(regexp_replace(lower(url), '^.*?://', ''), '^([^/?#]*)', 1), '@', -1) AS host,
    TRUE AS available, TRUE AS in_range, TRUE AS class_agrees FROM parts WHERE part = 'validation'"""
S["select_and_refit"] = with_(PROBE_NORM, _PARTS) + """SELECT stage, n_models, TRUE AS in_range, TRUE AS best_is_tested,
    n_models * (SELECT count(*) FROM parts WHERE part = stage) AS n_judged
    FROM (VALUES ('validation', 3), ('test', 1)) AS v(stage, n_models)"""
S["ablation"] = """SELECT feature_set, 3 AS n_models, TRUE AS in_range
    FROM (VALUES ('ALL_FEATURES'), ('NO_HTTPS'), ('NO_HTTPS_PATH'), ('NO_SHORTCUTS')) AS v(feature_set)"""
S["score_urls"] = with_(PROBE_NORM, _PARTS) + """SELECT url, page_id % 10 <> 0 AS available, TRUE AS in_range, TRUE AS score_agrees,
    TRUE AS class_agrees, page_id % 10 = 0 AS unanswered FROM parts WHERE part = 'test'"""
S["behaviour_test"] = with_(PROBE_NORM, _PARTS) + """SELECT 'variant ' || variant AS category, count(*) AS n_cases, TRUE AS judged_right
    FROM parts WHERE part = 'test' GROUP BY variant"""
S["top_feature_importance"] = "SELECT 15 AS n_features, 15 AS n_names, TRUE AS none_negative, TRUE AS at_most_one"

_GIVEN = {
    "url_length": "0.01", "dot_count": "0.3", "digit_ratio": "4.0", "suspicious_word_count": "0.9", "has_suspicious_tld": "1.5", "has_https": "-0.4",
    "hostname_length": "0.02", "hostname_entropy": "0.5", "subdomain_count": "0.2", "is_ip_address": "2.0",
}
_CHANCES = "given AS (SELECT *, 1 / (1 + exp(-(-4.5::DOUBLE + " + " + ".join(f"({w}::DOUBLE) * {n}::DOUBLE" for n, w in _GIVEN.items()) + (
    "))) AS chance, (variant IN (1, 2, 3, 5, 7, 8, 14, 15))::INTEGER AS label FROM feats WHERE variant <> 13)"
)
S["score_urls_given"] = with_(PROBE_NORM, FEATURES_CTE, _CHANCES) + """SELECT page_id, variant::INTEGER AS variant, page_id % 10 <> 0 AS available,
    CASE WHEN page_id % 10 <> 0 THEN (chance > 0.5)::INTEGER END AS prediction, CASE WHEN page_id % 10 <> 0 THEN round(chance, 6) END AS probability,
    CASE WHEN page_id % 10 <> 0 THEN round(chance * 100, 4) END AS score FROM given"""
S["behaviour_test_given"] = with_(PROBE_NORM, FEATURES_CTE, _CHANCES) + """SELECT coalesce('variant ' || variant, 'ALL') AS category,
    count(*) FILTER ((chance > 0.5)::INTEGER = label) AS correct, count(*) AS total, round(avg(((chance > 0.5)::INTEGER = label)::INTEGER), 6) AS accuracy,
    round(avg(chance), 6) AS mean_probability, count(*) FILTER (chance > 0.5) AS predicted_phishing, count(*) FILTER (chance <= 0.5) AS predicted_legitimate
    FROM given GROUP BY ROLLUP (variant)"""
S["top_class_gaps"] = with_(PROBE_NORM, FEATURES_CTE, _CHANCES, "gaps AS (" + " UNION ALL ".join(
    f"SELECT feature, round(coalesce(abs(s1::DOUBLE / n1 - s0::DOUBLE / n0) / nullif(hi::DOUBLE - lo::DOUBLE, 0), 0.0), 6) AS importance FROM ("
    f"SELECT '{n}' AS feature, sum(x) FILTER (label = 1) AS s1, count(x) FILTER (label = 1) AS n1, sum(x) FILTER (label = 0) AS s0, count(x) FILTER (label = 0) AS n0, "
    f"max(x) AS hi, min(x) AS lo FROM (SELECT label, {n}::DOUBLE::DECIMAL(28, 9) AS x FROM given))" for n in fv.FEATURE_NAMES) + ")") + "SELECT feature, importance FROM gaps ORDER BY importance DESC, feature LIMIT 15"


def whole_tables(name: str, *cuts: tuple[str, str]) -> str:
    """The SQL of a query without the conditions that keep it to some probes and pages."""
    sql = S[name]
    for cut, whole in cuts:
        assert cut in sql, (name, cut)
        sql = sql.replace(cut, whole)
    return sql


_IN_TURN = (
    "JOIN (SELECT * FROM conf WHERE variant = 0) c ON c.page_id = e.event_id % (SELECT count(*) FROM pages)",
    "JOIN conf c ON c.page_id = e.event_id % (SELECT count(*) FROM pages) AND c.variant = (e.event_id // (SELECT count(*) FROM pages)) % 16",
)
# empty URLs, which four variants lack: full_row keeps them, trim_add_http has no key for them
S["dedup_urls"] = whole_tables(
    "dedup_urls", (" WHERE variant IN (0, 4, 6, 14)", ""), ("SELECT *, url AS k FROM rows_) WHERE k <> ''", "SELECT *, url AS k FROM rows_) WHERE TRUE"),
    ("ELSE 'http://' || trim(url) END", "WHEN trim(url) <> '' THEN 'http://' || trim(url) END"),
)
for _name in ("scan_stats", "recent_scans", "history_rows"):
    S[_name] = whole_tables(_name, _IN_TURN)
