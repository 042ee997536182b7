"""DuckDB SQL for the normalised timestamps: one regular expression per notation, zones by the ICU extension.

DuckDB reads a wall time that occurs twice as the later instant, so the earlier one is taken where it has the same wall time.
"""

from __future__ import annotations

from graphloom.functions.timestamps import ABBREVIATIONS, MONTHS

_ZONE = r"(?: *([+-])(\d\d)(?::?(\d\d))?(?:\[[A-Za-z/_+\d-]+\])?| *([A-Za-z]{1,5}))?"
_TIME = r"(\d\d?):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?"
_PATTERNS = {
    "iso": (rf"^(\d{{4}})-(\d\d)-(\d\d)[Tt ] *{_TIME}{_ZONE}$", "yr mth dom hr mi sc fr sg zh zm zn"),
    "bas": (rf"^(\d{{4}})(\d\d)(\d\d)[Tt](\d\d)(\d\d)(\d\d){_ZONE}$", "yr mth dom hr mi sc sg zh zm zn"),
    "num": (rf"^(\d\d?)[./-](\d\d?)[./-](\d{{4}}),? +{_TIME}(?: *([APap][Mm]))?$", "n1 n2 yr hr mi sc fr hf"),
    "clf": (rf"^(\d\d?)/([A-Za-z]{{3}})/(\d{{4}}):{_TIME}{_ZONE}$", "dom mon yr hr mi sc fr sg zh zm zn"),
    "rfc": (rf"^(?:[A-Za-z]{{3,9}}, +)?(\d\d?) ([A-Za-z]{{3,9}}) (\d{{4}}) +{_TIME}{_ZONE}$", "dom mon yr hr mi sc fr sg zh zm zn"),
    "txt": (rf"^([A-Za-z]{{3,9}}) +(\d\d?), +(\d{{4}}) +{_TIME}(?: *([APap][Mm]))?$", "mon dom yr hr mi sc fr hf"),
}
_FIELDS = "yr mth dom hr mi sc fr hf sg zh zm zn mon n1 n2".split()


def _field(name: str) -> str:
    have = [f"nullif({p}.{name}, '')" for p, (_, names) in _PATTERNS.items() if name in names.split()]
    return f"coalesce({', '.join(have)})" if have else "NULL"


_EXTRACT = ", ".join(f"regexp_extract(x, '{pattern}', [{', '.join(repr(n) for n in names.split())}]) AS {p}" for p, (pattern, names) in _PATTERNS.items())
_MONTH = "CASE left(lower(mon), 3) " + " ".join(f"WHEN '{m[:3]}' THEN {i + 1}" for i, m in enumerate(MONTHS)) + " END"
_ABBREVIATION = "CASE lower(zn) " + " ".join(f"WHEN '{z}' THEN {m}" for z, m in ABBREVIATIONS.items()) + " END"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
TIMES = f"""
raw AS (SELECT DISTINCT 'runtime_events' AS source, event_id AS record_id, timestamp AS text, coalesce(nullif(trim(service), ''), nullif(trim(service_name), '')) AS svc FROM runtime_events
  UNION SELECT 'incidents', id, detected_at, nullif(trim(service_name), '') FROM incidents),
cut AS (SELECT r.*, s.tz_name AS tz, s.day_first, trim(text, {_BLANKS}) AS x FROM raw r LEFT JOIN (SELECT name, min(tz_name) AS tz_name, min(day_first) AS day_first FROM services GROUP BY 1) s ON s.name = r.svc),
part AS (SELECT source, record_id, text, tz, day_first, x, {', '.join(f'{_field(n)} AS {n}' for n in _FIELDS)} FROM (SELECT *, {_EXTRACT} FROM cut)),
num AS (SELECT *, CASE WHEN n1 IS NOT NULL THEN CASE day_first WHEN true THEN n2::INT WHEN false THEN n1::INT END WHEN mon IS NOT NULL THEN {_MONTH} ELSE mth::INT END AS mo, CASE WHEN n1 IS NOT NULL THEN CASE day_first WHEN true THEN n1::INT WHEN false THEN n2::INT END ELSE dom::INT END AS dy,
  CASE WHEN hf IS NULL THEN hr::INT WHEN hr::INT BETWEEN 1 AND 12 THEN hr::INT % 12 + CASE upper(hf) WHEN 'PM' THEN 12 ELSE 0 END END AS ho, coalesce(sc, '0')::INT AS se, left(rpad(coalesce(fr, ''), 6, '0'), 6)::BIGINT AS us FROM part),
wall AS (SELECT *, CASE WHEN ho < 24 AND mi::INT < 60 AND se < 60 AND yr::INT >= 1 THEN try_cast(yr || '-' || lpad(mo::VARCHAR, 2, '0') || '-' || lpad(dy::VARCHAR, 2, '0') AS DATE)::TIMESTAMP + to_seconds(ho * 3600 + mi::INT * 60 + se) END AS w FROM num),
utc AS (SELECT *, CASE WHEN zh IS NOT NULL THEN w - to_minutes((CASE sg WHEN '-' THEN -1 ELSE 1 END) * (zh::INT * 60 + coalesce(zm, '0')::INT)) WHEN zn IS NOT NULL THEN w - to_minutes({_ABBREVIATION})
  WHEN tz IS NOT NULL THEN (SELECT timezone('UTC', CASE WHEN timezone(tz, u - INTERVAL 1 HOUR) = w THEN u - INTERVAL 1 HOUR ELSE u END) FROM (SELECT timezone(tz, w) AS u)) END AS i FROM wall),
times AS (SELECT source, record_id, text, CASE WHEN regexp_matches(x, '^\\d{{10}}(\\.\\d+)?$') THEN left(x, 10)::BIGINT * 1000000 + left(rpad(split_part(x, '.', 2), 6, '0'), 6)::BIGINT WHEN regexp_matches(x, '^\\d{{13}}$') THEN x::BIGINT * 1000 WHEN regexp_matches(x, '^\\d{{16}}$') THEN x::BIGINT
  WHEN regexp_matches(x, '^\\d{{19}}$') THEN left(x, 16)::BIGINT ELSE epoch_us(i) + us END AS instant_us, coalesce(regexp_matches(text, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.][0-9]+)?Z$'), false) AS canonical FROM utc)
"""
FOUND = f"WITH {TIMES} SELECT DISTINCT record_id, instant_us FROM times WHERE instant_us IS NOT NULL AND NOT canonical"
ALL = f"WITH {TIMES} SELECT DISTINCT source, record_id, instant_us, CASE WHEN instant_us IS NULL THEN 'unresolved' WHEN canonical THEN 'canonical' ELSE 'converted' END AS status FROM times"
