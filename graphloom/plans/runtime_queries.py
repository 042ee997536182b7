"""Runtime events and incidents over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.redaction import SENSITIVE_KEYS, SENSITIVE_VALUES, redacted_map, redacted_text
from graphloom.operators import runtime
from graphloom.plans.catalog import Catalog

CATALOG = Catalog()
add = CATALOG.add
_KEYS = "(?i)" + "|".join(f"(?:{k})" for k in SENSITIVE_KEYS)


def _redact(text: str) -> str:
    for pattern, any_case, tag in SENSITIVE_VALUES:
        text = f"regexp_replace({text}, '{pattern}', '{tag.replace('$1', chr(92) + '1')}', '{'gi' if any_case else 'g'}')"
    return text


add(
    "run01_redacted_attributes",
    lambda t: t.runtime_events.select("event_id", F.explode(redacted_map(F.col("attributes"))).alias("key", "value")).distinct(),
    "",
    f"+++ SELECT DISTINCT event_id, key, CASE WHEN regexp_matches(key, '{_KEYS}') THEN '[REDACTED]' ELSE {_redact('value')} END AS value FROM (SELECT event_id, unnest(map_entries(attributes), recursive := true) FROM runtime_events)",
)
add("run02_redacted_messages", lambda t: t.runtime_events.select("event_id", redacted_text(F.col("message")).alias("message")).distinct(), "", f"+++ SELECT DISTINCT event_id, {_redact('message')} AS message FROM runtime_events")
_CORR = """
ke AS (SELECT DISTINCT snapshot_id, nullif(trim(attributes['symbol']), '') AS symbol, nullif(trim(attributes['route']), '') AS route, coalesce(nullif(trim(service), ''), nullif(trim(service_name), '')) AS service FROM runtime_events WHERE snapshot_id IS NOT NULL),
sy AS (SELECT k.snapshot_id, k.symbol, min(a.id) AS id FROM (SELECT DISTINCT snapshot_id, symbol FROM ke WHERE symbol IS NOT NULL) k JOIN art a ON a.snapshot_id = k.snapshot_id AND (a.name = k.symbol OR ends_with(a.qualified_name, '.' || k.symbol)) GROUP BY ALL),
ro AS (SELECT k.snapshot_id, k.route, min(a.id) AS id FROM (SELECT DISTINCT snapshot_id, route FROM ke WHERE route IS NOT NULL) k JOIN art a ON a.snapshot_id = k.snapshot_id AND a.artifact_type IN ('API_ENDPOINT', 'ENDPOINT', 'ROUTE') AND contains(lower(a.location), lower(k.route)) GROUP BY ALL),
se AS (SELECT k.snapshot_id, k.service, min({'rank': CASE WHEN lower(a.name) = lower(k.service) OR lower(a.qualified_name) = lower(k.service) THEN 4 ELSE 5 END, 'id': a.id}) AS m FROM (SELECT DISTINCT snapshot_id, service FROM ke WHERE service IS NOT NULL) k JOIN art a ON a.snapshot_id = k.snapshot_id AND (lower(a.qualified_name) = lower(k.service) OR contains(lower(a.name), lower(k.service))) GROUP BY ALL),
corr AS (SELECT ke.*, coalesce(sy.id, ro.id, se.m.id) AS artifact_id, CASE WHEN sy.id IS NOT NULL THEN 0.95 WHEN ro.id IS NOT NULL THEN 0.90 WHEN se.m.rank = 4 THEN 0.75 WHEN se.m.rank = 5 THEN 0.70 ELSE 0 END::DOUBLE AS confidence,
  CASE WHEN sy.id IS NOT NULL THEN 'SYMBOL_EXACT' WHEN ro.id IS NOT NULL THEN 'API_ROUTE' WHEN se.m.rank = 4 THEN 'SERVICE_NAME' WHEN se.m.rank = 5 THEN 'SERVICE_PARTIAL' ELSE 'UNMATCHED' END AS method
  FROM ke LEFT JOIN sy ON sy.snapshot_id = ke.snapshot_id AND sy.symbol = ke.symbol LEFT JOIN ro ON ro.snapshot_id = ke.snapshot_id AND ro.route = ke.route LEFT JOIN se ON se.snapshot_id = ke.snapshot_id AND se.service = ke.service)"""
add("jn09_correlations", lambda t: runtime.correlations(t.runtime_events, t.artifacts), "art", _CORR + "+++ SELECT * FROM corr")
add(
    "run03_ingested",
    lambda t: runtime.ingested(runtime.first_arrivals(t.runtime_events), t.artifacts).select("event_id", "service_name", "event_type", "severity", "environment", "message", "was_redacted", "artifact_id", "confidence", "method"),
    "art ev",
    _CORR + f"""+++ SELECT e.event_id, coalesce(nullif(trim(e.service), ''), nullif(trim(e.service_name), ''), e.component_name) AS service_name, upper(event_type) AS event_type, upper(severity) AS severity, coalesce(nullif(trim(environment), ''), 'production') AS environment, {_redact('message')} AS message,
      coalesce(len(list_filter(map_entries(attributes), lambda x: (regexp_matches(x.key, '{_KEYS}') AND x.value <> '[REDACTED]') OR (NOT regexp_matches(x.key, '{_KEYS}') AND {_redact('x.value')} <> x.value))) > 0, false) OR coalesce({_redact('message')} <> message, false) AS was_redacted,
      c.artifact_id, coalesce(c.confidence, 0) AS confidence, coalesce(c.method, 'NO_SNAPSHOT') AS method
      FROM ev e LEFT JOIN corr c ON c.snapshot_id = e.snapshot_id AND c.symbol IS NOT DISTINCT FROM nullif(trim(e.attributes['symbol']), '') AND c.route IS NOT DISTINCT FROM nullif(trim(e.attributes['route']), '') AND c.service IS NOT DISTINCT FROM coalesce(nullif(trim(e.service), ''), nullif(trim(e.service_name), ''))""",
)
_K = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))), '')".format
_EVIDENCE = f"""
direct AS (SELECT DISTINCT incident_id, event_id FROM (SELECT id AS incident_id, {_K('x')} AS event_id FROM (SELECT id, unnest(evidence_ids) AS x FROM inc) UNION SELECT incident_id, {_K('target_id')} FROM link WHERE target_type = 'runtime_event') WHERE event_id IN (SELECT {_K('event_id')} FROM runtime_events)),
newest AS (SELECT repository_id, event_id FROM (SELECT repository_id, event_id, min(ingested_at) AS at_ FROM runtime_events WHERE upper(severity) IN ('ERROR', 'CRITICAL') GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY at_ DESC, event_id) <= 10),
evidence AS (SELECT incident_id, event_id, 'LINKED' AS source FROM direct UNION ALL SELECT i.id, n.event_id, 'RECENT' FROM inc i JOIN newest n USING (repository_id) WHERE i.id NOT IN (SELECT incident_id FROM direct))"""
add("inc02_evidence", lambda t: runtime.incident_evidence(t.incidents, t.incident_links, t.runtime_events), "inc link", _EVIDENCE + "+++ SELECT * FROM evidence")
add(
    "inc02_components",
    lambda t: runtime.affected_components(t.incidents, runtime.incident_evidence(t.incidents, t.incident_links, t.runtime_events), t.runtime_events),
    "inc link",
    _EVIDENCE + f""", part AS (SELECT {_K('event_id')} AS event_id, min(component_artifact_id) AS component FROM runtime_events WHERE component_artifact_id IS NOT NULL GROUP BY 1), f AS (SELECT incident_id, arg_min(component, event_id) AS found FROM evidence JOIN part USING (event_id) GROUP BY 1)
      +++ SELECT i.id AS incident_id, coalesce(nullif(trim(affected_component_id), ''), found) AS component_id, CASE WHEN nullif(trim(affected_component_id), '') IS NOT NULL THEN 'OWN' WHEN found IS NOT NULL THEN 'EVENT' ELSE 'UNKNOWN' END AS source FROM inc i LEFT JOIN f ON f.incident_id = i.id""",
)
add("rsk06_component_health", lambda t: runtime.component_health(t.runtime_events, t.incidents), "inc ev", "e AS (SELECT component_artifact_id AS component_id, count(*) AS events, count(*) FILTER (upper(severity) IN ('ERROR', 'CRITICAL')) AS errors, count(*) FILTER (environment = 'production') AS production FROM ev WHERE component_artifact_id IS NOT NULL GROUP BY 1), i AS (SELECT affected_component_id AS component_id, count(*) AS incidents, count(*) FILTER (lower(severity) = 'critical') AS critical FROM inc WHERE affected_component_id IS NOT NULL GROUP BY 1) +++ SELECT coalesce(e.component_id, i.component_id) AS component_id, coalesce(events, 0) AS events, coalesce(errors, 0) AS errors, coalesce(production, 0) AS production, coalesce(incidents, 0) AS incidents, coalesce(critical, 0) AS critical FROM e FULL JOIN i ON i.component_id = e.component_id")
QUERIES, SQL = CATALOG.queries, CATALOG.sql
