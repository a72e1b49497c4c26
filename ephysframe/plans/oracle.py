"""DuckDB SQL for each registered query, over the driver's table views.

The role views below restate ``plans/roles.py`` in SQL; each query then
restates its operator's semantics in plain SQL. Keys match ``QUERIES``.
"""

from __future__ import annotations

ROLES = """
session AS (
  SELECT o_orderkey AS session_id, o_custkey AS subject_id, CAST(o_orderdate AS DATE) AS date,
         CASE WHEN o_orderkey % 50 <> 0 THEN string_split(o_orderpriority, '-') END AS keywords
  FROM orders),
performance AS (
  SELECT l_orderkey AS session_id, CAST(l_linenumber AS BIGINT) AS block_index,
         l_quantity AS same_modal_dprime, l_discount AS cross_modal_dprime
  FROM lineitem),
located AS (
  SELECT * FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
units AS (
  SELECT concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS unit_id,
         l_orderkey AS session_id,
         'probe' || chr(64 + l_linenumber) AS electrode_group_name,
         s_name AS location, CASE WHEN l_partkey % 29 <> 0 THEN n_name END AS structure,
         l_quantity * 25 AS ccf_ap, round(l_discount * 100) * 25 AS ccf_dv, round(l_tax * 100) * 25 AS ccf_ml,
         l_discount AS isi_violations_ratio, round(l_discount * 100) AS isi_violations_count,
         l_tax AS amplitude_cutoff, l_quantity AS presence_ratio
  FROM located),
electrodes AS (
  SELECT l_orderkey AS session_id, 'probe' || chr(64 + l_linenumber) AS group_name,
         l_quantity * 25 AS x, round(l_discount * 100) * 25 AS y, round(l_tax * 100) * 25 AS z,
         s_name AS location, CASE WHEN l_partkey % 29 <> 0 THEN n_name END AS structure
  FROM located),
electrode_groups AS (
  SELECT f.l_orderkey AS session_id, 'probe' || chr(64 + f.l_linenumber) AS name, p_name AS location
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk FROM lineitem GROUP BY 1, 2) f
  JOIN part ON p_partkey = f.pk),
raw_tree AS (
  SELECT CAST(4 AS BIGINT) AS id, 'root' AS acronym, 'root' AS name, 'root root' AS safe_name,
         CAST(NULL AS BIGINT) AS parent_structure_id, CAST(0 AS BIGINT) AS depth, '/4/' AS structure_id_path
  UNION ALL
  SELECT CAST(r_regionkey AS BIGINT) * 4 + 1, r_name, r_name, 'region ' || r_name, CAST(4 AS BIGINT), CAST(1 AS BIGINT),
         '/4/' || CAST(CAST(r_regionkey AS BIGINT) * 4 + 1 AS VARCHAR) || '/'
  FROM region
  UNION ALL
  SELECT CAST(n_nationkey AS BIGINT) * 4 + 2, n_name, n_name, 'nation ' || n_name, CAST(n_regionkey AS BIGINT) * 4 + 1,
         CAST(2 AS BIGINT),
         '/4/' || CAST(CAST(n_regionkey AS BIGINT) * 4 + 1 AS VARCHAR) || '/' || CAST(CAST(n_nationkey AS BIGINT) * 4 + 2 AS VARCHAR) || '/'
  FROM nation
  UNION ALL
  SELECT s_suppkey * 4 + 3, s_name, s_name, 'supplier ' || s_name, CAST(s_nationkey AS BIGINT) * 4 + 2, CAST(3 AS BIGINT),
         '/4/' || CAST(CAST(n_regionkey AS BIGINT) * 4 + 1 AS VARCHAR) || '/' || CAST(CAST(s_nationkey AS BIGINT) * 4 + 2 AS VARCHAR)
         || '/' || CAST(s_suppkey * 4 + 3 AS VARCHAR) || '/'
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
tree AS (
  SELECT *, lpad(upper(hex(id * 40503 % 16777216)), 6, '0') AS color_hex_triplet,
         CAST(id * 40503 % 16777216 AS INTEGER) AS color_hex_int,
         '0x' || lpad(upper(hex(id * 40503 % 16777216)), 6, '0') AS color_hex_str,
         ((id * 40503 % 16777216) // 65536) * (CAST(1 AS DOUBLE) / 255) AS color_r,
         ((id * 40503 % 16777216) // 256 % 256) * (CAST(1 AS DOUBLE) / 255) AS color_g,
         ((id * 40503 % 16777216) % 256) * (CAST(1 AS DOUBLE) / 255) AS color_b
  FROM raw_tree),
voxels AS (
  SELECT CAST(round(l_tax * 100) AS INTEGER) AS ml, CAST(round(l_discount * 100) AS INTEGER) AS dv,
         CAST(l_quantity AS INTEGER) AS ap,
         CASE WHEN min(l_suppkey) % 11 = 0 THEN 1 WHEN min(l_suppkey) % 7 = 0 THEN min(l_suppkey) % 5 * 5 * 4 + 2
              ELSE min(l_suppkey) * 4 + 3 END AS structure_id
  FROM lineitem GROUP BY 1, 2, 3),
midline AS (SELECT CAST(12.5 AS DOUBLE) * 10 AS m, 10 AS n_ml),
passing AS (
  SELECT session_id FROM performance
  WHERE same_modal_dprime > CAST(10.0 AS DOUBLE) AND cross_modal_dprime > CAST(0.02 AS DOUBLE)
  GROUP BY session_id HAVING count(block_index) > 1),
good_sessions AS (
  SELECT * FROM session
  WHERE NOT list_contains(keywords, 'LOW')
    AND session_id IN (SELECT session_id FROM passing)),
good AS (
  SELECT u.unit_id, s.session_id, s.subject_id, s.date, u.electrode_group_name, g.location AS implant_location,
         u.location, u.structure, u.ccf_ml > (SELECT m FROM midline) AS is_right_hemisphere,
         u.ccf_ap, u.ccf_dv, u.ccf_ml, t.id, t.color_hex_triplet, t.color_hex_int, t.safe_name
  FROM good_sessions s
  JOIN units u ON u.session_id = s.session_id
  JOIN electrode_groups g ON g.session_id = u.session_id AND g.name = u.electrode_group_name
  JOIN tree t ON t.acronym = u.location
  WHERE u.isi_violations_ratio < CAST(0.08 AS DOUBLE) AND u.amplitude_cutoff < CAST(0.08 AS DOUBLE)
    AND u.presence_ratio > CAST(10.0 AS DOUBLE))
"""


def _cte_join(ctes: str, body: str) -> str:
    """Join a CTE list with a body that either continues it (starts with
    a comma) or is the final statement."""
    rest = body.lstrip()
    if rest.startswith(","):
        return "WITH " + ctes + ",\n" + rest[1:].lstrip()
    return "WITH " + ctes + "\n" + body


def with_roles(body: str) -> str:
    return _cte_join(ROLES.strip(), body)


SQL: dict[str, str] = {}

SQL["qualifying_sessions"] = with_roles("""
SELECT session_id, subject_id, date, array_to_string(keywords, '-') AS keywords FROM good_sessions
""")

SQL["good_units"] = with_roles("""
SELECT unit_id, session_id, subject_id, date, electrode_group_name, implant_location, location, structure,
       is_right_hemisphere, ccf_ap, ccf_dv, ccf_ml, id, color_hex_triplet, color_hex_int
FROM good
""")

SQL["coverage_stats"] = with_roles("""
SELECT count(*) AS units, count(DISTINCT session_id) + max(CASE WHEN session_id IS NULL THEN 1 ELSE 0 END) AS sessions,
       count(DISTINCT subject_id) + max(CASE WHEN subject_id IS NULL THEN 1 ELSE 0 END) AS subjects
FROM good
""")

SQL["coverage_stats_ungated"] = with_roles("""
SELECT count(*) AS units, count(DISTINCT s.session_id) AS sessions, count(DISTINCT s.subject_id) AS subjects
FROM session s
JOIN units u ON u.session_id = s.session_id
JOIN electrode_groups g ON g.session_id = u.session_id AND g.name = u.electrode_group_name
JOIN tree t ON t.acronym = u.location
WHERE s.session_id IN (SELECT session_id FROM performance)
""")

SQL["unit_locations_v1"] = with_roles("""
SELECT u.session_id, u.location, count(u.location) AS location_count,
       arg_min_null(u.structure, (u.unit_id, u.electrode_group_name)) AS structure,
       arg_min(s.subject_id, (u.unit_id, u.electrode_group_name)) AS subject_id,
       arg_min(s.date, (u.unit_id, u.electrode_group_name)) AS date,
       arg_min(g.location, (u.unit_id, u.electrode_group_name)) AS implant_location,
       array_to_string(list_sort(list(u.unit_id)), ',') AS unit_ids
FROM good_sessions s
JOIN units u ON u.session_id = s.session_id
JOIN electrode_groups g ON g.session_id = u.session_id AND g.name = u.electrode_group_name
WHERE u.isi_violations_count < CAST(8.0 AS DOUBLE) AND u.amplitude_cutoff < CAST(0.08 AS DOUBLE)
  AND u.presence_ratio > CAST(10.0 AS DOUBLE)
GROUP BY u.session_id, u.location
""")


def children_cte(terms: list[str], roots_sql: str | None = None) -> str:
    """In-volume frontier descendants (term_idx, acronym) of each term, as SQL.

    Left-hemisphere labels; a labelled node under the root counts when no
    labelled proper ancestor sits at or below the root. ``roots_sql`` gives
    the (term_idx, root_id) rows directly instead of looking up ``terms``.
    """
    roots = roots_sql or " UNION ALL ".join(
        f"SELECT {i} AS term_idx, id AS root_id FROM tree WHERE acronym = '{t}'" for i, t in enumerate(terms)
    )
    return f"""
vol AS (SELECT DISTINCT structure_id AS id FROM voxels WHERE ml < (SELECT n_ml // 2 FROM midline)),
pn AS (SELECT id, CAST(unnest(parts) AS BIGINT) AS node, unnest(range(len(parts))) AS pos
       FROM (SELECT id, list_filter(string_split(structure_id_path, '/'), lambda x: x <> '') AS parts FROM tree)),
lab AS (SELECT * FROM pn WHERE id IN (SELECT id FROM vol)),
lastv AS (SELECT id, max(pos) AS lp FROM lab WHERE node IN (SELECT id FROM vol) AND node <> id GROUP BY id),
roots AS ({roots}),
children AS (
  SELECT r.term_idx, t.acronym FROM roots r JOIN lab ON lab.node = r.root_id LEFT JOIN lastv ON lastv.id = lab.id
  JOIN tree t ON t.id = lab.id WHERE lastv.lp IS NULL OR lab.pos > lastv.lp)"""


def with_children(terms: list[str], body: str, matched_where: str | None = None) -> str:
    extra = ""
    if matched_where is not None:
        extra = f",\nmatched AS (SELECT * FROM good WHERE {matched_where})"
    return _cte_join(ROLES.strip() + "," + children_cte(terms) + extra, body)


GOOD_COLS = """unit_id, session_id, subject_id, date, electrode_group_name, implant_location, location, structure,
       is_right_hemisphere, ccf_ap, ccf_dv, ccf_ml, id, color_hex_triplet, color_hex_int"""
PREFIX = "Supplier#0000000"
LEFT = "is_right_hemisphere = false"
NATION_MATCH = f"{LEFT} AND location IN (SELECT acronym FROM children)"

SQL["unit_counts"] = with_roles("""
SELECT session_id, location, count(location) AS location_count,
       arg_min_null(structure, (unit_id, electrode_group_name)) AS structure,
       arg_min(subject_id, (unit_id, electrode_group_name)) AS subject_id,
       arg_min(date, (unit_id, electrode_group_name)) AS date,
       arg_min(implant_location, (unit_id, electrode_group_name)) AS implant_location,
       arg_min(electrode_group_name, (unit_id, electrode_group_name)) AS electrode_group_name,
       array_to_string(list_sort(list(unit_id)), ',') AS unit_ids
FROM good GROUP BY session_id, location
""")

SQL["units_at_location_starts_with"] = with_roles(f"""
SELECT {GOOD_COLS} FROM good WHERE {LEFT} AND starts_with(location, '{PREFIX}') ORDER BY date, location
""")

SQL["units_at_location_contains"] = with_roles(f"""
SELECT {GOOD_COLS} FROM good WHERE regexp_matches(location, '#00000001[0-9]$')
""")

SQL["units_at_location_case_insensitive"] = with_roles(f"""
SELECT {GOOD_COLS} FROM good WHERE {LEFT} AND starts_with(lower(location), lower('{PREFIX}'))
""")

SQL["units_at_location_children_of"] = with_children(["AMERICA", "ASIA"], f"""
SELECT {GOOD_COLS} FROM good WHERE {LEFT} AND location IN (SELECT acronym FROM children)
""")

SQL["units_at_location_any"] = with_roles(f"""
SELECT {GOOD_COLS} FROM good WHERE {LEFT} AND location IS NOT NULL
""")

SQL["location_breakdown"] = with_roles(f"""
, counts AS (
  SELECT session_id, location, count(location) AS location_count,
         arg_min(subject_id, (unit_id, electrode_group_name)) AS subject_id
  FROM good WHERE {LEFT} AND starts_with(location, '{PREFIX}') GROUP BY session_id, location)
SELECT subject_id, location, CAST(sum(location_count) AS BIGINT) AS units,
       (SELECT CAST(sum(location_count) AS BIGINT) FROM counts) AS total_units,
       (SELECT count(DISTINCT session_id) FROM counts) AS total_sessions
FROM counts GROUP BY subject_id, location
""")

SQL["co_recorded_structures"] = with_children(["NATION_18"], """
, other AS (
  SELECT * FROM good
  WHERE session_id IN (SELECT session_id FROM matched) AND unit_id IS NOT NULL AND structure IS NOT NULL
    AND unit_id NOT IN (SELECT unit_id FROM matched WHERE unit_id IS NOT NULL)),
per AS (SELECT structure, session_id, count(unit_id) AS unit_count FROM other GROUP BY structure, session_id),
top AS (SELECT structure, CAST(sum(unit_count) AS BIGINT) AS total_structure_count FROM per GROUP BY structure
        ORDER BY total_structure_count DESC, structure ASC NULLS LAST LIMIT 15)
SELECT per.structure, per.session_id, per.unit_count, top.total_structure_count
FROM per JOIN top ON per.structure = top.structure
""", NATION_MATCH)

SQL["location_summary"] = with_roles(f"""
, matched AS (SELECT * FROM good WHERE {LEFT} AND starts_with(location, '{PREFIX}')),
s AS (
  SELECT location,
         count(DISTINCT unit_id) + max(CASE WHEN unit_id IS NULL THEN 1 ELSE 0 END) AS units,
         count(DISTINCT session_id) + max(CASE WHEN session_id IS NULL THEN 1 ELSE 0 END) AS sessions,
         count(DISTINCT subject_id) + max(CASE WHEN subject_id IS NULL THEN 1 ELSE 0 END) AS subjects,
         arg_min_null(structure, (unit_id, session_id)) AS structure,
         arg_min(safe_name, (unit_id, session_id)) AS description
  FROM good WHERE {LEFT} GROUP BY location),
q AS (SELECT location AS queried, min(color_hex_triplet) AS colour FROM matched GROUP BY location)
SELECT s.*, q.queried IS NOT NULL AS selected,
       CASE WHEN q.queried IS NOT NULL THEN '#' || q.colour END AS highlight,
       row_number() OVER (ORDER BY (q.queried IS NOT NULL) DESC, s.units DESC, s.location ASC NULLS LAST) - 1 AS index
FROM s LEFT JOIN q ON q.queried = s.location
""")

SQL["implant_value_counts"] = with_roles(f"""
, v1 AS (
  SELECT u.session_id, u.location, arg_min(g.location, (u.unit_id, u.electrode_group_name)) AS implant_location
  FROM good_sessions s
  JOIN units u ON u.session_id = s.session_id
  JOIN electrode_groups g ON g.session_id = u.session_id AND g.name = u.electrode_group_name
  WHERE u.isi_violations_count < CAST(8.0 AS DOUBLE) AND u.amplitude_cutoff < CAST(0.08 AS DOUBLE)
    AND u.presence_ratio > CAST(10.0 AS DOUBLE)
  GROUP BY u.session_id, u.location)
SELECT implant_location, count(*) AS count FROM v1 WHERE starts_with(location, '{PREFIX}') GROUP BY implant_location
""")

PROBE_SELECT = """
SELECT e.session_id, e.electrode_group_name, g.location AS implant_location, e.ccf_ml, e.ccf_ap, e.ccf_dv,
       e.location, e.structure, e.is_right_hemisphere, t.color_hex_triplet, t.color_hex_int, t.color_hex_str,
       round(t.color_r, 9) AS color_r, round(t.color_g, 9) AS color_g, round(t.color_b, 9) AS color_b"""


def probe_sql(hits_sql: str, n_terms: int, join_on: list[str], filters: str = "TRUE", term_filter: bool = True,
              units_table: str = "matched") -> str:
    """Electrodes (left) of probes hitting every term, coinciding with a matched unit."""
    cond = " AND ".join(f"m.{k} = e.{k}" for k in join_on)
    probe_filter = ""
    if term_filter:
        probe_filter = f"""AND (e.session_id, e.electrode_group_name) IN (
    SELECT session_id, electrode_group_name FROM vals JOIN hits USING (value)
    GROUP BY session_id, electrode_group_name HAVING count(DISTINCT term_idx) = {n_terms})"""
    return f""",
el AS (
  SELECT session_id, group_name AS electrode_group_name, x AS ccf_ap, y AS ccf_dv, z AS ccf_ml, location, structure,
         z > (SELECT m FROM midline) AS is_right_hemisphere
  FROM electrodes WHERE NOT (z > (SELECT m FROM midline))),
vals AS (SELECT session_id, electrode_group_name, v AS value FROM el, unnest([location, structure]) AS t(v)
         WHERE v IS NOT NULL),
dv AS (SELECT DISTINCT value FROM vals),
hits AS ({hits_sql}),
pl AS ({PROBE_SELECT}
  FROM el e
  JOIN electrode_groups g ON g.session_id = e.session_id AND g.name = e.electrode_group_name
  JOIN tree t ON t.acronym = e.location
  WHERE EXISTS (SELECT 1 FROM {units_table} m WHERE {cond})
    AND e.ccf_ap > -1 AND e.ccf_dv > -1 AND e.ccf_ml > -1 AND {filters}
    {probe_filter})"""


CHILD_HITS = "SELECT DISTINCT c.term_idx, dv.value FROM dv JOIN children c ON contains(dv.value, c.acronym)"
POS_KEYS = ["session_id", "electrode_group_name", "ccf_ap", "ccf_dv", "ccf_ml"]
PROBE_KEYS = ["session_id", "electrode_group_name"]

SQL["probe_locations_children_of"] = with_children(
    ["NATION_18"], probe_sql(CHILD_HITS, 1, POS_KEYS) + "\nSELECT * FROM pl", NATION_MATCH
)

SQL["probe_locations_contains_whole_probe"] = with_roles(
    """
, matched AS (SELECT * FROM good WHERE is_right_hemisphere = false AND
   (regexp_matches(location, 'NATION_1') OR regexp_matches(location, 'Supplier#00000001')))"""
    + probe_sql(
        "SELECT 0 AS term_idx, value FROM dv WHERE regexp_matches(value, 'NATION_1') UNION ALL "
        "SELECT 1 AS term_idx, value FROM dv WHERE regexp_matches(value, 'Supplier#00000001')",
        2, PROBE_KEYS, "regexp_matches(g.location, '^s') AND e.electrode_group_name = 'probeB'",
    )
    + "\nSELECT * FROM pl"
)

SQL["missed_insertions"] = with_children(["NATION_18"], """
, everything AS (SELECT * FROM good WHERE is_right_hemisphere = false AND location IS NOT NULL)"""
    + probe_sql("SELECT 0 AS term_idx, value FROM dv", 0, PROBE_KEYS,
                "regexp_matches(g.location, 'small') AND e.electrode_group_name = 'probeB'", term_filter=False,
                units_table="everything")
    + """,
hit_pl AS (SELECT * FROM pl WHERE (session_id, electrode_group_name) IN (
    SELECT session_id, electrode_group_name FROM vals JOIN (""" + CHILD_HITS + """) h USING (value)
    GROUP BY session_id, electrode_group_name HAVING count(DISTINCT term_idx) = 1)
  AND (session_id, electrode_group_name) IN (SELECT session_id, electrode_group_name FROM matched))
SELECT * FROM pl WHERE (session_id, electrode_group_name) NOT IN (SELECT session_id, electrode_group_name FROM hit_pl)
""", NATION_MATCH)

SQL["insertion_hit_rate"] = with_children(["NATION_18"], probe_sql(CHILD_HITS, 1, POS_KEYS) + """,
ins AS (
  SELECT *, CAST(session_id AS VARCHAR) || '_' || electrode_group_name || '_' || implant_location AS insertion_id
  FROM matched WHERE (session_id, electrode_group_name) IN (SELECT session_id, electrode_group_name FROM pl)),
tot AS (SELECT electrode_group_name, implant_location,
               count(DISTINCT session_id) + max(CASE WHEN session_id IS NULL THEN 1 ELSE 0 END) AS total
        FROM good GROUP BY electrode_group_name, implant_location),
g AS (
  SELECT i.electrode_group_name, i.implant_location,
         count(DISTINCT insertion_id) + max(CASE WHEN insertion_id IS NULL THEN 1 ELSE 0 END) AS hits,
         min(total) AS total
  FROM ins i JOIN tot ON tot.electrode_group_name = i.electrode_group_name AND tot.implant_location = i.implant_location
  WHERE total > 0 GROUP BY i.electrode_group_name, i.implant_location),
r AS (
  SELECT string_split(implant_location, ' ')[1] AS implant, string_split(implant_location, ' ')[2] AS hole,
         regexp_replace(electrode_group_name, 'probe', '') AS probe, hits, total,
         floor((200 * hits + total) / (2 * total)) / 100.0 AS rate
  FROM g)
SELECT *, CAST(sum(hits) OVER (PARTITION BY implant) AS BIGINT) AS total_hits_this_implant FROM r WHERE rate IS NOT NULL
""", NATION_MATCH)

SQL["overlay_regions"] = with_children(["NATION_18"], """
SELECT DISTINCT CASE WHEN (SELECT count(DISTINCT location) + max(CASE WHEN location IS NULL THEN 1 ELSE 0 END)
                           FROM matched) > 1 THEN structure ELSE location END AS area
FROM matched
""", NATION_MATCH)

SQL["overlay_regions_single"] = with_roles("""
, matched AS (SELECT * FROM good WHERE starts_with(location, 'Supplier#000000011'))
SELECT DISTINCT CASE WHEN (SELECT count(DISTINCT location) FROM matched) > 1 THEN structure ELSE location END AS area
FROM matched
""")

DPRIME = """
WITH blocks AS (
  SELECT event_id AS block_index, CASE WHEN user_id % 41 <> 0 THEN user_id END AS subject_id, CAST(ts AS DATE) AS date,
         CAST(user_id AS VARCHAR) || '_' || strftime(CAST(ts AS DATE), '%Y-%m-%d') || '_0' AS session_id,
         CASE WHEN event_type IN ('view', 'signup') THEN value END AS vis,
         CASE WHEN event_type = 'click' THEN value WHEN event_type = 'signup' THEN value * 2 END AS aud
  FROM events),
b2 AS (SELECT *, (coalesce(vis, 0) + coalesce(aud, 0))
                 / nullif(CAST(vis IS NOT NULL AS INTEGER) + CAST(aud IS NOT NULL AS INTEGER), 0) AS mean_dprime
       FROM blocks),
num AS (SELECT subject_id, session_id,
               dense_rank() OVER (PARTITION BY subject_id ORDER BY session_id) AS session_number
        FROM (SELECT DISTINCT subject_id, session_id FROM b2)),
per AS (SELECT session_id, arg_min(subject_id, block_index) AS subject_id, arg_min(date, block_index) AS date,
               avg(mean_dprime) AS mean_dprime, count(block_index) AS num_blocks
        FROM b2 WHERE mean_dprime IS NOT NULL GROUP BY session_id),
fd AS (SELECT subject_id, min(date) AS first_date FROM per GROUP BY subject_id),
result AS (
  SELECT per.session_id, per.subject_id, per.date, num.session_number, round(per.mean_dprime, 6) AS mean_dprime,
         per.num_blocks, CAST(date_diff('day', fd.first_date, per.date) AS BIGINT) AS days_since_first_session
  FROM per JOIN num ON num.subject_id IS NOT DISTINCT FROM per.subject_id AND num.session_id = per.session_id
  JOIN fd ON fd.subject_id IS NOT DISTINCT FROM per.subject_id)
"""

SQL["session_mean_dprime"] = DPRIME + "SELECT * FROM result ORDER BY subject_id, date"
SQL["dprime_over_time"] = DPRIME + """
SELECT session_id, subject_id, CAST(date AS VARCHAR) AS date, session_number, mean_dprime, num_blocks,
       days_since_first_session
FROM result WHERE subject_id IN (1, 2, 3, 4, 17)"""

SQL["structure_tree"] = with_roles("""
SELECT id, acronym, parent_structure_id, depth, structure_id_path, color_hex_triplet, color_hex_int, color_hex_str,
       round(color_r, 9) AS color_r, round(color_g, 9) AS color_g, round(color_b, 9) AS color_b
FROM tree
""")


def frontier_sql(roots_sql: str, body: str) -> str:
    return _cte_join(ROLES.strip() + "," + children_cte([], roots_sql), body)


SQL["frontier_descendants"] = frontier_sql("SELECT 0 AS term_idx, id AS root_id FROM tree", """
SELECT r.root_id, lab.id FROM roots r JOIN lab ON lab.node = r.root_id LEFT JOIN lastv ON lastv.id = lab.id
WHERE lastv.lp IS NULL OR lab.pos > lastv.lp
""")

SQL["immediate_children"] = with_roles("""
SELECT parent_structure_id AS root_id, id FROM tree WHERE parent_structure_id IN (SELECT id FROM tree)
""")

SQL["acronym_lookup"] = with_roles("""
SELECT k.acronym, t.id
FROM (SELECT DISTINCT structure AS acronym FROM units WHERE structure IS NOT NULL) k
LEFT JOIN (SELECT acronym, min(id) AS id FROM tree GROUP BY acronym) t ON t.acronym = k.acronym
""")

SQL["id_lookup"] = with_roles("""
SELECT k.id, t.acronym
FROM (SELECT DISTINCT structure_id AS id FROM voxels) k
LEFT JOIN (SELECT id, min(acronym) AS acronym FROM tree GROUP BY id) t ON t.id = k.id
""")

SQL["structure_info"] = with_roles("""
SELECT id, acronym, name, safe_name, parent_structure_id, depth, structure_id_path, color_hex_triplet,
       color_hex_int, color_hex_str
FROM tree WHERE acronym IN (SELECT r_name FROM region)
""")

SQL["volume_acronyms"] = with_children(["root"], """
SELECT acronym FROM tree WHERE id IN (SELECT id FROM vol)
""")

SQL["volume_hemispheres"] = with_roles("""
SELECT n_ml, m AS midline_um,
       (SELECT count(*) FROM voxels WHERE ml < (SELECT n_ml // 2 FROM midline)) AS left_voxels,
       (SELECT count(*) FROM voxels WHERE ml >= (SELECT n_ml // 2 FROM midline)) AS right_voxels
FROM midline
""")

EUROPE_MASK = """
SELECT ml, dv, ap, structure_id FROM voxels
WHERE ml < (SELECT n_ml // 2 FROM midline)
  AND structure_id IN (SELECT t.id FROM children c JOIN tree t ON t.acronym = c.acronym)"""

SQL["region_mask"] = with_children(["EUROPE"], EUROPE_MASK)

SQL["projection_area"] = with_children(["EUROPE"], f"""
, mask AS ({EUROPE_MASK}),
nd AS (SELECT 12 AS n),
b AS (SELECT greatest(round_even((n // 2) - 0.5 * n, 0), 0) AS lo, least(round_even((n // 2) + 0.5 * n, 0) + 1, n) AS hi
      FROM nd),
cnt AS (SELECT ap AS y, ml AS x, count(*) AS n FROM mask, b WHERE dv >= lo AND dv < hi GROUP BY ap, ml),
rgb AS (SELECT color_r, color_g, color_b FROM tree WHERE acronym = 'EUROPE')
SELECT y, x, round(color_r, 9) AS r, round(color_g, 9) AS g, round(color_b, 9) AS b,
       round(CAST(n AS DOUBLE) / (SELECT max(n) FROM cnt), 9) AS a
FROM cnt, rgb
""")

SQL["projection_slab"] = with_roles("""
, mask AS (SELECT * FROM voxels WHERE ml < (SELECT n_ml // 2 FROM midline) AND structure_id > 0),
nd AS (SELECT 52 AS n),
b AS (SELECT greatest(round_even((n // 2) - 0.5 * 10, 0), 0) AS lo, least(round_even((n // 2) + 0.5 * 10, 0) + 1, n) AS hi
      FROM nd)
SELECT dv AS y, ml AS x, round(CAST(0.6 AS DOUBLE) * 255, 9) AS r, round(CAST(0.6 AS DOUBLE) * 255, 9) AS g,
       round(CAST(0.6 AS DOUBLE) * 255, 9) AS b, CAST(1.0 AS DOUBLE) AS a
FROM mask, b WHERE ap >= lo AND ap < hi GROUP BY dv, ml
""")

SQL["scatter_density"] = with_roles(f"""
, matched AS (SELECT * FROM good WHERE {LEFT} AND starts_with(location, '{PREFIX}')),
shape AS (SELECT 52 AS h, 5 AS w),
pts AS (SELECT ccf_ap / 25 AS fy, ccf_ml / 25 AS fx, h, w FROM matched, shape
        WHERE ccf_ap / 25 >= 0 AND ccf_ap / 25 <= h AND ccf_ml / 25 >= 0 AND ccf_ml / 25 <= w),
bins AS (SELECT CAST(CASE WHEN fy = h THEN h - 1 ELSE floor(fy) END AS BIGINT) AS y,
                CAST(CASE WHEN fx = w THEN w - 1 ELSE floor(fx) END AS BIGINT) AS x, count(*) AS n
         FROM pts GROUP BY 1, 2),
op AS (SELECT y, x, CAST(0.7 AS DOUBLE) + (CAST(1.0 AS DOUBLE) - CAST(0.7 AS DOUBLE))
                    * (CAST(n AS DOUBLE) / (SELECT max(n) FROM bins)) AS raw FROM bins),
al AS (SELECT y, x, least(greatest(CASE WHEN raw <= 0.7 THEN 0.0 ELSE raw END, 0.0), 1.0) AS a FROM op)
SELECT y, x, CAST(1.0 AS DOUBLE) AS r, CAST(1.0 AS DOUBLE) AS g, CAST(1.0 AS DOUBLE) AS b, round(a, 9) AS a
FROM al WHERE a > 0
""")

BOARDS = """
WITH bs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS subject_id, CAST(o_orderdate AS DATE) AS date,
         CASE WHEN o_orderstatus = 'P' THEN 'behavior' ELSE 'ecephys' END AS platform
  FROM orders),
assets AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS session_id, 'raw_' || o_orderkey AS asset_id, 'raw' AS kind,
         o_orderdate AS created, false AS failed, CAST(NULL AS VARCHAR[]) AS sorted_probes,
         CAST(NULL AS VARCHAR) AS output
  FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL
  SELECT CAST(l_orderkey AS VARCHAR), concat_ws('_', 'sorted', l_orderkey, l_linenumber, l_partkey, l_suppkey), 'sorted',
         l_shipdate, l_returnflag = 'A', list_transform(range(1, l_linenumber + 1), lambda i: chr(CAST(64 + i AS INTEGER))),
         'sorted ' || l_linenumber || ' probes'
  FROM lineitem WHERE l_returnflag <> 'N'),
comps AS (
  SELECT concat_ws('_', 'job', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS name,
         CASE WHEN l_returnflag = 'R' THEN 'trigger' ELSE 'sorting' END AS cap, l_linestatus = 'O' AS in_progress,
         'raw_' || l_orderkey AS asset,
         CASE WHEN l_linenumber % 2 = 0 THEN 'input data asset ID' ELSE 'other' END AS pname,
         CASE WHEN l_linenumber % 2 = 1 THEN 'input_data_asset_ID' ELSE 'x' END AS pkey
  FROM lineitem)
"""

SQL["find_sessions"] = BOARDS + """
SELECT DISTINCT * FROM bs
WHERE subject_id IN ('7', '13', '1001') AND platform = 'ecephys'
  AND date >= DATE '1996-01-01' AND date <= DATE '1998-12-31'
"""

SQL["sorting_status"] = BOARDS + """,
raw AS (SELECT session_id, arg_max(asset_id, (created, asset_id)) AS raw_asset FROM assets WHERE kind = 'raw'
        GROUP BY session_id),
srt AS (SELECT session_id, arg_max({'a': asset_id, 'f': failed, 'p': sorted_probes, 'o': output}, (created, asset_id)) AS s
        FROM assets WHERE kind = 'sorted' GROUP BY session_id),
jobs AS (SELECT r.session_id, list_sort(list(c.name)) AS jobs FROM raw r JOIN comps c ON c.asset = r.raw_asset
         WHERE c.in_progress AND c.cap = 'sorting' GROUP BY r.session_id),
t AS (
  SELECT s.id AS session, s.subject_id AS subject, raw.raw_asset, srt.s.a AS sorted_asset, srt.s.f AS failed,
         srt.s.p AS sorted_probes, srt.s.o AS output,
         CASE WHEN raw.raw_asset IS NOT NULL THEN coalesce(jobs.jobs, []) END AS jr
  FROM bs s LEFT JOIN raw ON raw.session_id = s.id LEFT JOIN srt ON srt.session_id = s.id
  LEFT JOIN jobs ON jobs.session_id = s.id
  WHERE s.platform = 'ecephys'),
t2 AS (SELECT *, coalesce(len(jr) > 0, false) AS busy FROM t),
t3 AS (SELECT *, CASE WHEN busy THEN NULL ELSE NOT failed END AS success FROM t2)
SELECT subject, session, raw_asset, CASE WHEN raw_asset IS NOT NULL THEN sorted_asset END AS latest_sorted_asset,
       array_to_string(jr, ',') AS jobs_running, success,
       CASE WHEN busy THEN NULL ELSE array_to_string(list_sort(sorted_probes), ',') END AS complete_probe_data,
       NOT coalesce(success, false) AS needs_attention,
       concat_ws(chr(10),
         CASE WHEN raw_asset IS NOT NULL THEN 'raw asset ID: ' || raw_asset END,
         CASE WHEN busy THEN 'sorting jobs in progress: ' || array_to_string(jr, ', ')
              WHEN output IS NULL THEN 'no sorted data found'
              ELSE 'sorted asset ID: ' || sorted_asset || chr(10) || chr(10) || 'output:' || chr(10) || output END
       ) AS detail
FROM t3 ORDER BY session
"""

SQL["already_triggered"] = BOARDS + """
SELECT asset AS asset_id, max(name) AS job_name FROM comps
WHERE in_progress AND cap = 'trigger' AND (pname = 'input data asset ID' OR pkey = 'input_data_asset_ID')
GROUP BY asset
"""

FOLDER = """'DRpilot_' || CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 10000000 ELSE o_custkey END || '_' ||
         CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || '_'
              ELSE strftime(o_orderdate, '%Y%m%d') || '_' END || o_orderkey"""
DATE = r"(?:^|\D)((?:19|20)\d{2})-?(0[1-9]|1[0-2])-?(0[1-9]|[12]\d|3[01])(?:\D|$)"

UPLOAD = f"""
WITH folders AS (
  SELECT {FOLDER} AS folder,
         o_orderstatus <> 'P' AS has_ephys
  FROM orders),
lo AS (
  SELECT *, {FOLDER} AS folder
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'),
m1 AS (
  SELECT folder, arg_min(strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'), (l_linenumber, l_partkey, l_suppkey, l_shipdate))
                   FILTER (WHERE l_returnflag <> 'N') AS dt
  FROM lo WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY folder),
m2 AS (
  SELECT folder,
         arg_min(strftime(l_shipdate, '%Y-%m-%d'), (l_linenumber, l_partkey, l_suppkey, l_shipdate))
           FILTER (WHERE l_returnflag <> 'N')
         || '_' ||
         arg_min(strftime(l_shipdate, '%H:%M:%S'), (l_linenumber, l_partkey, l_suppkey, l_shipdate))
           FILTER (WHERE l_returnflag <> 'R') AS dt
  FROM lo WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY folder),
dts AS (SELECT folder, replace(replace(dt, ':', '-'), ' ', '_') AS dt FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2)),
up AS (SELECT DISTINCT 'ecephys_' || o_custkey || '_' || strftime(l_shipdate, '%Y-%m-%d_%H-%M-%S') AS upload_session_id
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F'),
b AS (
  SELECT regexp_extract(f.folder, '([0-9]+)', 1) AS subject, f.has_ephys AS ephys,
         CAST(try_strptime(regexp_extract(f.folder, '{DATE}', 1) || regexp_extract(f.folder, '{DATE}', 2)
                           || regexp_extract(f.folder, '{DATE}', 3), '%Y%m%d') AS DATE) AS date, f.folder,
         d.folder IS NOT NULL AS started, d.dt
  FROM folders f LEFT JOIN dts d ON d.folder = f.folder
  WHERE starts_with(f.folder, 'DRpilot') AND NOT contains(f.folder, '366122')),
c AS (SELECT *, CASE WHEN started THEN 'ecephys_' || subject || '_' || dt END AS upload_session_id FROM b)
SELECT subject, ephys, date, folder, started, upload_session_id,
       CASE WHEN started THEN upload_session_id IS NOT NULL AND upload_session_id IN (SELECT upload_session_id FROM up) END AS finished
FROM c
"""

SQL["upload_status"] = UPLOAD
SQL["upload_status_unstarted"] = UPLOAD + "WHERE ephys AND NOT started"

SQL["inventory_apply"] = """
WITH cur AS (
  SELECT 'P' || c_custkey AS serial_number, CAST(NULL AS DATE) AS date_installed, CAST(NULL AS DATE) AS date_removed,
         CAST(NULL AS VARCHAR) AS issue, c_mktsegment AS rig, 'nation ' || c_nationkey AS storage_location,
         c_acctbal < 0 AS is_destroyed
  FROM customer),
ch AS (
  SELECT 'P' || (user_id * 11) AS serial_number, ts, event_id, CAST(ts AS DATE) AS date_installed,
         CASE WHEN event_type = 'signup' THEN CAST(ts AS DATE) END AS date_removed,
         CASE WHEN event_type = 'error' THEN props ELSE '' END AS issue, event_type AS rig, '' AS storage_location,
         CASE WHEN event_type = 'error' THEN true END AS is_destroyed
  FROM events),
latest AS (
  SELECT serial_number,
         arg_max({'di': date_installed, 'dr': date_removed, 'i': issue, 'r': rig, 's': storage_location,
                  'd': is_destroyed}, (ts, event_id)) AS x
  FROM ch GROUP BY serial_number)
SELECT * FROM cur WHERE serial_number NOT IN (SELECT serial_number FROM latest)
UNION ALL
SELECT serial_number, x.di, x.dr, nullif(x.i, ''), nullif(x.r, ''), nullif(x.s, ''), coalesce(x.d, false) FROM latest
"""

SQL["qc_manifest"] = """
WITH files AS (SELECT regexp_replace(url, '^[a-z]+://', 'qc/') AS path FROM pages),
f AS (SELECT path, list_filter(string_split(path, '/'), lambda p: p <> '') AS parts FROM files),
f2 AS (
  SELECT path, parts[-1] AS name, regexp_extract(parts[-1], '(\\.[^.]*)$', 1) AS suffix,
         regexp_replace(parts[-1], '\\.[^.]*$', '') AS stem, CAST(len(parts) - 1 AS INTEGER) AS depth
  FROM f WHERE NOT list_contains(parts, '.vscode')),
sess AS (SELECT CAST(o_orderkey AS VARCHAR) || '_0' AS session_id FROM orders),
m AS (
  SELECT DISTINCT s.session_id, f2.path FROM f2 JOIN sess s
    ON length(s.session_id) > 2 AND starts_with(f2.name, substr(s.session_id, 1, length(s.session_id) - 2))),
o AS (
  SELECT m.session_id, f2.path, f2.name, f2.suffix,
         CASE WHEN f2.suffix = '.png' THEN 'figure'
              WHEN f2.suffix = '.json' AND NOT contains(f2.name, 'plotly') THEN 'json' END AS kind,
         trim(replace(f2.stem, '_', ' ')) AS title, f2.depth
  FROM m JOIN f2 ON f2.path = m.path)
SELECT o.*, o.path = min(o.path) OVER (PARTITION BY o.session_id) AS is_first FROM o
"""

SQL["column_filters"] = with_roles(f"""
SELECT {GOOD_COLS} FROM good
WHERE contains(location, '#00000002') AND ccf_ap > 100.0 AND is_right_hemisphere = false AND contains(structure, 'NATION')
""")

SQL["session_table"] = "SELECT CAST(o_orderkey AS VARCHAR) || '_0' AS session_id FROM orders ORDER BY session_id DESC"

SQL["location_legend"] = with_roles(f"""
SELECT DISTINCT location FROM good WHERE {LEFT} AND starts_with(location, '{PREFIX}') ORDER BY location NULLS FIRST
""")

SQL["inventory_table"] = SQL["inventory_apply"].replace(
    "SELECT * FROM cur WHERE serial_number NOT IN (SELECT serial_number FROM latest)",
    "SELECT serial_number, strftime(date_installed, '%Y-%m-%d') AS date_installed, "
    "strftime(date_removed, '%Y-%m-%d') AS date_removed, issue, rig, storage_location, is_destroyed "
    "FROM cur WHERE serial_number NOT IN (SELECT serial_number FROM latest)",
).replace(
    "SELECT serial_number, x.di, x.dr,",
    "SELECT serial_number, strftime(x.di, '%Y-%m-%d'), strftime(x.dr, '%Y-%m-%d'),",
)

SQL["sorting_status_compact"] = SQL["sorting_status"].replace(
    "SELECT subject, session, raw_asset, CASE WHEN raw_asset IS NOT NULL THEN sorted_asset END AS latest_sorted_asset,\n"
    "       array_to_string(jr, ',') AS jobs_running,",
    "SELECT session, array_to_string(jr, ',') AS jobs_running,",
).split("       concat_ws(chr(10),")[0].rstrip().rstrip(",") + "\nFROM t3\n"

SQL["scatter_missed_insertions"] = with_children(["NATION_18"], """
, everything AS (SELECT * FROM good WHERE is_right_hemisphere = false AND location IS NOT NULL)"""
    + probe_sql("SELECT 0 AS term_idx, value FROM dv", 0, PROBE_KEYS,
                "regexp_matches(g.location, 'small') AND e.electrode_group_name = 'probeB'", term_filter=False,
                units_table="everything")
    + """,
hit_pl AS (SELECT * FROM pl WHERE (session_id, electrode_group_name) IN (
    SELECT session_id, electrode_group_name FROM vals JOIN (""" + CHILD_HITS + """) h USING (value)
    GROUP BY session_id, electrode_group_name HAVING count(DISTINCT term_idx) = 1)
  AND (session_id, electrode_group_name) IN (SELECT session_id, electrode_group_name FROM matched)),
missed AS (SELECT * FROM pl WHERE (session_id, electrode_group_name) NOT IN (SELECT session_id, electrode_group_name FROM hit_pl)),
shape AS (SELECT 12 AS h, 5 AS w),
pts AS (SELECT ccf_dv / 25 AS fy, ccf_ml / 25 AS fx, h, w FROM missed, shape
        WHERE ccf_dv / 25 >= 0 AND ccf_dv / 25 <= h AND ccf_ml / 25 >= 0 AND ccf_ml / 25 <= w),
bins AS (SELECT CAST(CASE WHEN fy = h THEN h - 1 ELSE floor(fy) END AS BIGINT) AS y,
                CAST(CASE WHEN fx = w THEN w - 1 ELSE floor(fx) END AS BIGINT) AS x, count(*) AS n
         FROM pts GROUP BY 1, 2),
op AS (SELECT y, x, CAST(0.7 AS DOUBLE) + (CAST(1.0 AS DOUBLE) - CAST(0.7 AS DOUBLE))
                    * (CAST(n AS DOUBLE) / (SELECT max(n) FROM bins)) AS raw FROM bins),
al AS (SELECT y, x, least(greatest(CASE WHEN raw <= 0.7 THEN 0.0 ELSE raw END, 0.0), 1.0) AS a FROM op)
SELECT y, x, CAST(0.0 AS DOUBLE) AS r, CAST(0.0 AS DOUBLE) AS g, CAST(0.0 AS DOUBLE) AS b, round(a, 9) AS a
FROM al WHERE a > 0
""", NATION_MATCH)

SQL["coverage_stats_thresholds"] = with_roles("""
SELECT count(*) AS units, count(DISTINCT session_id) AS sessions, count(DISTINCT subject_id) AS subjects,
       CAST(10.0 AS DOUBLE) AS same_modal_dprime, CAST(0.02 AS DOUBLE) AS cross_modal_dprime, CAST(0.08 AS DOUBLE) AS max_isi,
       CAST(0.08 AS DOUBLE) AS max_amp_cutoff, CAST(10.0 AS DOUBLE) AS min_presence
FROM good
""")

SQL["units_at_location_contains_case_insensitive"] = with_roles(f"""
SELECT {GOOD_COLS} FROM good WHERE {LEFT} AND regexp_matches(location, '^supplier[^0-9]0+1[0-9]$', 'i')
""")

SQL["location_breakdown_sessions"] = SQL["location_breakdown"].replace("SELECT subject_id, location, CAST", "SELECT session_id, location, CAST").replace(
    "FROM counts GROUP BY subject_id, location", "FROM counts GROUP BY session_id, location"
)

SQL["probe_locations_children_of_two"] = with_children(
    ["NATION_18", "NATION_8"], probe_sql(CHILD_HITS, 2, POS_KEYS) + "\nSELECT * FROM pl", NATION_MATCH
)

SQL["pick_structure"] = with_roles(f"""
SELECT structure FROM (SELECT DISTINCT structure FROM good WHERE unit_id IS NOT NULL AND {LEFT} AND structure IS NOT NULL)
ORDER BY md5(structure || '|7'), structure LIMIT 1
""")

SQL["session_sketches"] = with_roles("""
, p AS (
  SELECT electrode_group_name AS part, session_id FROM good
  UNION ALL SELECT 'small implants', session_id FROM good WHERE contains(implant_location, 'small')
  UNION ALL SELECT 'prefix', session_id FROM good WHERE starts_with(location, 'Supplier#0000000'))
SELECT part, count(DISTINCT session_id) AS exact_sessions, true AS in_range FROM p GROUP BY part
""")

SQL["approx_location_stats"] = with_children(["NATION_18"], probe_sql(CHILD_HITS, 1, POS_KEYS) + """
SELECT count(DISTINCT session_id) AS exact_sessions, count(DISTINCT location) AS exact_locations,
       true AS sessions_in_range, true AS locations_in_range
FROM pl
""", NATION_MATCH)

SQL["region_mask_right"] = SQL["region_mask"].replace("WHERE ml < (SELECT n_ml // 2 FROM midline)\n  AND structure_id", "WHERE ml >= (SELECT n_ml // 2 FROM midline)\n  AND structure_id")

SQL["projection_sagittal"] = with_roles("""
, cnt AS (SELECT dv AS y, ap AS x, count(*) AS n FROM voxels
          WHERE ml < (SELECT n_ml // 2 FROM midline) AND structure_id > 0 GROUP BY dv, ap)
SELECT y, x, CAST(0.6 AS DOUBLE) AS r, CAST(0.6 AS DOUBLE) AS g, CAST(0.6 AS DOUBLE) AS b,
       round(CAST(n AS DOUBLE) / (SELECT max(n) FROM cnt), 9) AS a
FROM cnt
""")

SQL["find_sessions_on_date"] = BOARDS + """
SELECT DISTINCT * FROM bs
WHERE CAST(subject_id AS BIGINT) BETWEEN 1 AND 199 AND platform = 'ecephys' AND date = DATE '1997-07-10'
"""

SQL["column_filters_below"] = with_roles(f"""
SELECT {GOOD_COLS} FROM good WHERE ccf_ap < 500.0 AND contains(location, '9')
""")
