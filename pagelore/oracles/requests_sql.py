"""Check statements for batches of owner-checked requests."""

from __future__ import annotations

from pagelore.oracles.base import C


def owned(name: str, view: str, refused: str, owners: str) -> str:
    """Outcomes by the first allowed request of each row; ``owners`` gives id and user_id of every row that has an owner."""
    return f"""
SELECT '{name}' AS table_name, * FROM (
  WITH chosen AS (SELECT id, user_id FROM ({owners}) WHERE id % 7 < 3),
  asked AS (SELECT id * 10 AS request_id, id, user_id + CASE WHEN id % 5 = 1 THEN 1 ELSE 0 END AS user_id FROM chosen
            UNION ALL SELECT id * 10 + 1, id, user_id FROM chosen WHERE id % 2 = 0 OR id % 3 = 0 UNION ALL SELECT id * 10 + 2, -id, user_id FROM chosen WHERE id % 4 = 1),
  judged AS (SELECT a.*, o.user_id IS NOT NULL AS there, coalesce(o.user_id = a.user_id, false) AS allowed FROM asked a LEFT JOIN (SELECT DISTINCT * FROM ({owners})) o USING (id)),
  firsts AS (SELECT id, min(request_id) AS first FROM judged WHERE allowed GROUP BY 1)
  SELECT request_id, CASE WHEN there AND NOT allowed AND (first IS NULL OR request_id < first) THEN '{refused}'
         WHEN allowed AND request_id = first THEN '{name} deleted' ELSE '{name} not found' END AS outcome
  FROM judged LEFT JOIN firsts USING (id)
  UNION ALL SELECT id, 'kept' FROM {view} WHERE id NOT IN (SELECT id FROM firsts))"""


_PARTS = [owned(n, v, f"{n} not found", f"SELECT id, user_id FROM {v}") for n, v in (("Bookmark", "bookmarks_v"), ("Annotation", "annotations_v"), ("Task", "tasks_v"))]
_PARTS += [
    owned("FAQ", "faqs_v", "Not authorized", "SELECT f.id, d.owner_id AS user_id FROM faqs_v f JOIN docs_v d ON d.id = f.document_id"),
    "SELECT 'Tag', document_id, 'Tag deleted' FROM tags_v WHERE document_id % 3 = 0 AND tag LIKE 'src%'",
    "SELECT 'Tag', document_id, 'kept' FROM tags_v WHERE NOT (document_id % 3 = 0 AND tag LIKE 'src%')",
]

SQL = {
    "delete_owned": C.sql(" UNION ALL ".join(_PARTS), "bookmarks_v", "annotations_v", "tasks_v", "faqs_v", "docs_v", "tags_v"),
    "upsert_preferences": C.sql("""
SELECT user_id, coalesce(u.theme, CASE WHEN p.user_id IS NULL THEN 'light' ELSE p.theme END) AS theme,
       coalesce(u.language, CASE WHEN p.user_id IS NULL THEN 'en' ELSE p.language END) AS language,
       coalesce(u.preferences_json, CASE WHEN p.user_id IS NULL THEN '{}' ELSE p.preferences_json END) AS preferences_json
FROM prefs_v p FULL JOIN (
  SELECT user_id, max_by(theme, request_id) FILTER (theme IS NOT NULL) AS theme, max_by(language, request_id) FILTER (language IS NOT NULL) AS language,
         max_by(preferences_json, request_id) FILTER (preferences_json IS NOT NULL) AS preferences_json FROM (
    SELECT o_orderkey AS request_id, o_custkey AS user_id, CASE o_orderkey % 4 WHEN 0 THEN 'dark' WHEN 1 THEN 'light' END AS theme,
           CASE o_orderkey % 3 WHEN 0 THEN 'es' END AS language, CASE WHEN o_orderkey % 5 = 0 THEN '{"last": ' || o_orderkey || '}' END AS preferences_json FROM orders)
  GROUP BY 1) u USING (user_id)""", "prefs_v"),
    "switch_users": C.sql("""
SELECT * FROM (
  WITH asked AS (
    SELECT o_orderkey AS request_id, o_orderkey % 97 AS admin_id, CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey % 97 WHEN o_orderkey % 17 = 0 THEN -o_custkey ELSE o_custkey END AS user_id,
           CASE o_orderkey % 4 WHEN 0 THEN 'teacher' WHEN 1 THEN 'admin' WHEN 2 THEN 'owner' END AS role FROM orders),
  judged AS (
    SELECT a.*, CASE WHEN s.role IS NULL OR s.role <> 'admin' THEN 'Role ' || chr(39) || coalesce(s.role, '') || chr(39) || ' not authorized'
           WHEN admin_id = user_id THEN CASE WHEN a.role IS NOT NULL THEN 'Cannot change your own role' ELSE 'Cannot deactivate yourself' END
           WHEN t.id IS NULL THEN 'User not found' WHEN a.role = 'owner' THEN 'Invalid role: owner' ELSE 'ok' END AS outcome
    FROM asked a LEFT JOIN users_v s ON s.id = a.admin_id LEFT JOIN users_v t ON t.id = a.user_id),
  changes AS (SELECT user_id, max_by(role, request_id) FILTER (role IS NOT NULL) AS role, count(*) FILTER (role IS NULL) % 2 = 1 AS turned FROM judged WHERE outcome = 'ok' GROUP BY 1)
  SELECT 'request' AS kind, request_id AS id, outcome FROM judged
  UNION ALL SELECT 'user', u.id, coalesce(c.role, u.role) || '|' || (u.is_active <> coalesce(turned, false))::VARCHAR FROM users_v u LEFT JOIN changes c ON c.user_id = u.id)""", "users_v"),
}
