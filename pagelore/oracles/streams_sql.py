"""Check statements for the streaming queries."""

from __future__ import annotations

from pagelore.functions import fixed_values as fv
from pagelore.oracles.analytics_sql import SQL as ANALYTICS
from pagelore.oracles.base import C

# the chain of sets of each key, one recursion step per set
C.add("requests_at", "SELECT event_id, cache_key, epoch_us(ts) AS at_us FROM requests_v", "requests_v")
_TTL = fv.CACHE_TTL_SECONDS * 1_000_000
C.add("cache_sets", f"""! AS (
SELECT cache_key, min(at_us) AS set_us FROM requests_at GROUP BY 1
UNION ALL
SELECT * FROM (SELECT s.cache_key, min(r.at_us) AS set_us FROM cache_sets s JOIN requests_at r ON r.cache_key = s.cache_key AND r.at_us > s.set_us + {_TTL} GROUP BY 1))""", "requests_at")
_HITS = C.sql("""
SELECT event_id, cache_key, NOT (at_us IN (SELECT set_us FROM cache_sets s WHERE s.cache_key = r.cache_key)
         AND row_number() OVER (PARTITION BY cache_key, at_us ORDER BY event_id) = 1) AS is_hit FROM requests_at r""", "requests_at", "cache_sets")

_WINDOWS = """
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL '7' DAY, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, count(*) AS n
FROM (SELECT event_type, date_trunc('day', ts) - i * INTERVAL '1' DAY AS w FROM events, range(0, 7) r(i)) GROUP BY w, event_type"""

SQL = {
    "stream_ingest": C.sql("SELECT c.*, sha256(d.text) AS file_hash FROM chunks_v c JOIN documents d ON d.doc_id = c.document_id WHERE d.doc_id % 50 <> 7", "chunks_v"),
    "stream_dedupe": C.sql("SELECT sha256(text) AS file_hash, min(doc_id) AS first_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM docs_v WHERE status = 'processed') GROUP BY 1", "docs_v"),
    "cache_hits_ttl": _HITS,
    "cache_hits_stream": _HITS,
    "recent_activity": _WINDOWS,
    "recent_activity_stream": _WINDOWS,
    "feedback_live": ANALYTICS["feedback_stats"],
}
