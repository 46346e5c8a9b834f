"""The scan in SQL, for comparison with the scan in Spark: every place of a text is tried against every recognizer.

The engine that runs it has no look-around, so what may stand before and behind an identifier is tested on its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterable

from .operators import policy, redact

W = r"[\p{L}\p{N}_]"
EDGE = f"regexp_matches(ch, '{W}') <> regexp_matches(prev, '{W}')"
END = rf"(?:$|[^\p{{L}}\p{{N}}_])"
NO_DIGIT, NO_DIGIT_END = "NOT regexp_matches(prev, '[0-9]')", "(?:$|[^0-9])"
NO_PHONE, NO_PHONE_END = r"NOT regexp_matches(prev, '[.\p{L}\p{N}_]')", "(?:$|[^0-9.])"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def digits(n: int, weights: Iterable[int]) -> str:
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: CAST(d[i] AS INTEGER) * {list(weights)}[i]))"


LUHN = """(len(d) >= 13 AND len(list_distinct(string_split(d, ''))) > 1 AND list_sum(list_transform(range(0, len(d)),
  lambda i: CASE WHEN i % 2 = 1 THEN 2 * CAST(d[len(d) - i] AS INTEGER) - CASE WHEN d[len(d) - i] > '4' THEN 9 ELSE 0 END
  ELSE CAST(d[len(d) - i] AS INTEGER) END)) % 10 = 0)"""
IBAN = """regexp_full_match(d, '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}') AND list_reduce(list_prepend(0, list_transform(string_split(d[5:] || d[1:4], ''),
  lambda c: CAST(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS INTEGER))), lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END) = 1"""
NRIC = f"""substr(CASE WHEN d[1] IN ('S', 'T') THEN 'JZIHGFEDCBA' WHEN d[1] IN ('F', 'G') THEN 'XWUTRQPNMLK' ELSE 'KLJNPQRTUWX' END,
  CAST(({digits(7, (2, 7, 6, 5, 4, 3, 2)).replace("d[i]", "d[i + 1]")} + CASE WHEN d[1] IN ('T', 'G') THEN 4 WHEN d[1] = 'M' THEN 3 ELSE 0 END) % 11 + 1 AS INTEGER), 1) = d[9]"""
HKID = """CAST((11 - (CASE WHEN len(d) = 8 THEN 324 + (ascii(d) - 55) * 8 ELSE (ascii(d) - 55) * 9 + (ascii(d[2]) - 55) * 8 END
  + list_sum(list_transform(range(1, 7), lambda i: CAST(d[len(d) - 7 + i] AS INTEGER) * (8 - i)))) % 11) % 11 AS VARCHAR) = CASE WHEN d[len(d)] = 'A' THEN '10' ELSE d[len(d)] END"""
MY_NUMBER = """len(list_distinct(string_split(d, ''))) > 1 AND CAST(d[12] AS INTEGER) = CASE WHEN list_sum(list_transform(range(1, 12), lambda n: CAST(d[12 - n] AS INTEGER) * CASE WHEN n <= 6 THEN n + 1 ELSE n - 5 END)) % 11 <= 1 THEN 0
  ELSE 11 - list_sum(list_transform(range(1, 12), lambda n: CAST(d[12 - n] AS INTEGER) * CASE WHEN n <= 6 THEN n + 1 ELSE n - 5 END)) % 11 END"""
TFN = f"{digits(9, (1, 4, 3, 7, 5, 8, 6, 9, 10))} % 11 = 0"
ABN = f"d[1] <> '0' AND ({digits(11, (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19))} - 10) % 89 = 0"
MEDICARE = f"{digits(8, (1, 3, 7, 9, 1, 3, 7, 9))} % 10 = CAST(d[9] AS INTEGER)"
SSN = "d[1:3] NOT IN ('000', '666') AND d[1:3] < '900' AND d[5:6] <> '00' AND d[8:11] <> '0000'"
IP = "len(list_filter(string_split(d, '.'), lambda p: CAST(p AS INTEGER) > 255)) = 0"
PHONE = "len(regexp_replace(d, '[^0-9]', '', 'g')) BETWEEN 8 AND 15"
_PARTS = "string_split(replace(d, '/', '-'), '-')"
BIRTH = rf"""CASE WHEN regexp_full_match(d, '[0-9]{{1,2}}(/[0-9]{{1,2}}/|-[0-9]{{1,2}}-)([0-9]{{4}}|[0-9]{{2}})')
  THEN {_PARTS}[3] <> '0000' AND try_cast(CASE WHEN len({_PARTS}[3]) = 2 THEN '20' ELSE '' END || {_PARTS}[3] || '-' || lpad({_PARTS}[2], 2, '0') || '-' || lpad({_PARTS}[1], 2, '0') AS DATE) IS NOT NULL
  WHEN regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN d[1:4] <> '0000' AND try_cast(d AS DATE) IS NOT NULL
  ELSE coalesce(try_strptime(d, '%d %b %Y'), try_strptime(d, '%d %B %Y')) IS NOT NULL END"""

#: name: pattern, what may stand before it, what may follow, the text a checksum is taken over, the checksum
RULES: dict[str, tuple[str, str, str, str, str]] = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", EDGE, END, "v", "true"),
    "credit_card": (r"(?:[0-9][ -]?){12,18}[0-9]", "NOT regexp_matches(prev, '[0-9A-Za-z]')", "(?:$|[^0-9A-Za-z])", "translate(v, ' -', '')", LUHN),
    "iban": (r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", EDGE, END, "replace(v, ' ', '')", IBAN),
    "sg_nric": (r"[STFGMstfgm][0-9]{7}[A-Za-z]", EDGE, END, "upper(v)", NRIC),
    "hk_hkid": (r"[A-Z]{1,2}[0-9]{6}\(?[0-9A]\)?", EDGE, "", "translate(v, '()', '')", HKID),
    "jp_my_number": (r"[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}", f"{NO_DIGIT} AND NOT regexp_full_match(prev2, '[0-9][- ]')", "(?:$|[^0-9 -]|[ -](?:$|[^0-9]))", "translate(v, ' -', '')", MY_NUMBER),
    "au_tfn": (r"[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{3}", NO_DIGIT, NO_DIGIT_END, "translate(v, ' -', '')", TFN),
    "au_abn": (r"[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}", NO_DIGIT, NO_DIGIT_END, "replace(v, ' ', '')", ABN),
    "au_medicare": (r"[2-6][0-9]{3} ?[0-9]{5} ?[0-9](?: ?/? ?[0-9])?", NO_DIGIT, NO_DIGIT_END, "translate(v, ' /', '')", MEDICARE),
    "us_ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", NO_DIGIT, NO_DIGIT_END, "v", SSN),
    "ip_address": (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", EDGE, END, "v", IP),
    "phone_intl": (r"(?:\+[0-9]{1,3}(?:[ -][0-9]{1,4}){1,4}|\+[0-9]{8,15})", NO_PHONE, NO_PHONE_END, "v", PHONE),
    "phone_local": (r"(?:\([0-9]{2,4}\)[ -]?)?[0-9]{2,4}[ -][0-9]{3,4}(?:[ -][0-9]{3,4})?", NO_PHONE, NO_PHONE_END, "v", PHONE),
    "passport": (r"[A-Z]{1,2}[0-9]{6,8}", EDGE, END, "v", "true"),
    "date_of_birth": (rf"(?i:[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}} (?:{MONTHS})[a-z]* [0-9]{{4}})", EDGE, END, "v", BIRTH),
}


# Fixed values, stated here anew, so that a wrong one in the recognizers shows: label, confidence without and with context, whether
# context is needed, whether there is a checksum, context words. Their order is that in which ties are settled.
PHONE_WORDS = ("phone", "mobile", "tel", "call", "contact", "whatsapp", "hp", "電話", "携帯", "連絡先")
FACTS: dict[str, tuple[str, float, float, bool, bool, tuple[str, ...]]] = {
    "email": ("EMAIL_ADDRESS", 0.9, 0.99, False, False, ("email", "e-mail", "mail", "メール")),
    "credit_card": ("CREDIT_CARD", 0.98, 0.99, False, True, ("card", "visa", "mastercard", "amex", "credit", "debit", "カード", "クレジット")),
    "iban": ("IBAN", 0.98, 0.99, False, True, ("iban", "account", "transfer", "bank", "口座", "銀行", "振込")),
    "sg_nric": ("SG_NRIC", 0.98, 0.99, False, True, ("nric", "fin", "identity", "ic number", "uin")),
    "hk_hkid": ("HK_HKID", 0.98, 0.99, False, True, ("hkid", "identity card", "identity")),
    "jp_my_number": ("JP_MY_NUMBER", 0.98, 0.99, False, True, ("my number", "mynumber", "マイナンバー", "個人番号")),
    "au_tfn": ("AU_TFN", 0.65, 0.85, True, True, ("tfn", "tax file")),
    "au_abn": ("AU_ABN", 0.98, 0.99, False, True, ("abn", "business number")),
    "au_medicare": ("AU_MEDICARE", 0.98, 0.99, False, True, ("medicare",)),
    "us_ssn": ("US_SSN", 0.8, 0.99, False, True, ("ssn", "social security")),
    "ip_address": ("IP_ADDRESS", 0.75, 0.95, False, True, ("ip", "address", "host", "server", "ipアドレス", "サーバー")),
    "phone_intl": ("PHONE_NUMBER", 0.6, 0.8, False, True, PHONE_WORDS),
    "phone_local": ("PHONE_NUMBER", 0.5, 0.7, True, True, PHONE_WORDS),
    "passport": ("PASSPORT", 0.4, 0.6, True, False, ("passport", "パスポート", "旅券")),
    "date_of_birth": ("DATE_OF_BIRTH", 0.75, 0.95, True, True, ("born", "birth", "dob", "d.o.b", "birthday", "生年月日", "誕生日", "出生")),
}


def strings(values: Iterable[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def findings(source: str, names: Iterable[str] = tuple(RULES)) -> str:
    """SQL of all findings (k, s, e, v, entity, conf, boosted, validated, name) of source, which gives k and t."""
    chosen = [(n, name) for n, name in enumerate(FACTS) if name in set(names)]
    raw = "\n  UNION ALL ".join(
        f"SELECT k, p, {n} AS ord, regexp_extract(rest, '^({RULES[r][0]}){RULES[r][2]}', 1) AS v FROM ch WHERE {RULES[r][1]} AND regexp_matches(rest, '^(?:{RULES[r][0]}){RULES[r][2]}')"
        for n, r in chosen
    )
    told = lambda n, name, entity, plain, high, needs, checked, words: f"({n}, '{name}', '{entity}', {plain}::DOUBLE, {high}::DOUBLE, {str(needs).lower()}, {str(checked).lower()}, [{strings(words)}])"
    rec = ", ".join(told(n, r, *FACTS[r]) for n, r in chosen)
    over = " ".join(f"WHEN {n} THEN {RULES[r][3]}" for n, r in chosen)
    valid = " ".join(f"WHEN {n} THEN ({RULES[r][4]})" for n, r in chosen)
    near = 48
    return rf"""
WITH src AS (SELECT k, t FROM ({source}) WHERE regexp_matches(t, '[0-9@]')),
pos AS (SELECT k, t, unnest(range(1, len(t) + 1)) AS p FROM src),
ch AS (
  SELECT k, p, substr(t, p, 1) AS ch, CASE WHEN p > 1 THEN substr(t, p - 1, 1) ELSE '' END AS prev, CASE WHEN p > 2 THEN substr(t, p - 2, 2) ELSE '' END AS prev2, substr(t, p, 200) AS rest
  FROM pos WHERE regexp_matches(substr(t, p, 1), '[A-Za-z0-9._%+(-]')
),
rec AS (SELECT * FROM (VALUES {rec}) AS r(ord, name, entity, plain, high, needs, validated, words)),
raw AS ({raw}),
runs AS (SELECT k, ord, list([{{'s': p - 1, 'e': p - 1 + len(v), 'v': v}}] ORDER BY p) AS l FROM raw GROUP BY k, ord),
kept AS (SELECT k, ord, unnest(list_reduce(l, lambda a, x: CASE WHEN x[1].s >= a[-1].e THEN a || x ELSE a END)) AS m FROM runs),
made AS (
  SELECT k, ord, m.s AS s, m.e AS e, m.v AS v, CASE ord {over.replace("(v", "(m.v").replace("THEN v", "THEN m.v")} END AS d, name, entity, plain, high, needs, validated,
    len(list_filter(words, lambda w: contains(lower(substr(t, greatest(m.s - {near}, 0) + 1, m.e + {near} - greatest(m.s - {near}, 0))), w))) > 0 AS boosted
  FROM kept JOIN src USING (k) JOIN rec USING (ord)
),
good AS (SELECT k, ord, s, e, v, name, entity, validated, boosted, CASE WHEN boosted THEN high ELSE plain END AS conf FROM made WHERE CASE ord {valid} END AND (boosted OR NOT needs)),
best AS (
  SELECT k, unnest(list_reduce(list([{{'s': s, 'e': e, 'v': v, 'name': name, 'entity': entity, 'validated': validated, 'boosted': boosted, 'conf': conf}}] ORDER BY validated DESC, conf DESC, e - s DESC, s, ord),
    lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN a ELSE a || x END)) AS f
  FROM good GROUP BY k
),
found AS (SELECT k, f.s AS s, f.e AS e, f.v AS v, f.entity AS entity, f.conf AS conf, f.boosted AS boosted, f.validated AS validated, f.name AS name FROM best)
"""


def rows(source: str, key: str, names: Iterable[str] = tuple(RULES)) -> str:
    return f"""{findings(source, names)} SELECT k AS {key}, entity AS entity_type, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", v AS text, conf AS confidence,
  'regex:' || name AS recognizer, validated, boosted AS context_boosted FROM found"""


DOCUMENTS = "SELECT doc_id AS k, text AS t FROM documents"
_LISTED = f"entity IN ({strings(policy.BLOCK)}) AS blocks, entity IN ({strings(policy.REDACT)}) AND conf >= {policy.Policy().least_confidence} AS redacts"

EGRESS = f"""{findings(DOCUMENTS)},
n AS (SELECT k, count_if(blocks) AS b, count_if(redacts) AS r FROM (SELECT k, {_LISTED} FROM found) GROUP BY k)
SELECT lang, CASE WHEN b > 0 THEN 'BLOCK' WHEN r > 0 THEN 'REDACT' ELSE 'ALLOW' END AS action, count(*) AS documents, CAST(sum(coalesce(b, 0) + coalesce(r, 0)) AS BIGINT) AS findings_considered
FROM documents LEFT JOIN n ON doc_id = k GROUP BY ALL"""

REASONS = f"""{findings(DOCUMENTS)},
w AS (SELECT *, 'characters ' || s || '-' || e || ' by regex:' || name || CASE WHEN validated THEN ', checksum-validated' ELSE '' END AS detail, {_LISTED} FROM found),
a AS (
  SELECT k, 'HIGH' AS severity, entity || ' must not leave' AS summary, detail FROM w WHERE blocks
  UNION ALL SELECT k, 'MEDIUM', entity || ' must be redacted', detail FROM w WHERE redacts
)
SELECT doc_id, coalesce(severity, 'LOW') AS severity, coalesce(summary, 'nothing to act on') AS summary, coalesce(detail, 'no finding is on a list') AS detail FROM documents LEFT JOIN a ON doc_id = k"""

REDACTED = f"""{findings(DOCUMENTS)},
r AS (
  SELECT k, s, e, lag(e, 1, 0) OVER (PARTITION BY k ORDER BY s) AS before,
    CASE WHEN entity IN ({strings(redact.DEFAULTS)}) THEN CASE WHEN len(v) > 4 THEN repeat('*', len(v) - 4) || right(v, 4) ELSE repeat('*', len(v)) END ELSE '<' || entity || '>' END AS made
  FROM found
),
j AS (SELECT k, string_agg(substr(t, before + 1, s - before) || made, '' ORDER BY s) AS head, max(e) AS last FROM r JOIN src USING (k) GROUP BY k)
SELECT doc_id, CASE WHEN head IS NULL THEN text ELSE head || substr(text, last + 1) END AS redacted FROM documents LEFT JOIN j ON doc_id = k"""
