"""DuckDB SQL restating every registered query, for the correctness check.

The test tables (``events``, ``part``, ``documents`` ...) are views in the
checking session. Each statement first rebuilds the source shapes with the
same binding rules as ``hirescope.sources.bindings`` and then states the
model in plain SQL. Shares are cast to DOUBLE on both sides.
"""

from hirescope.functions.experience import YEARS_PATTERN
from hirescope.functions.noise import NOISE_TERMS
from hirescope.functions.text import TOKEN_SPLIT

_NOISE_SQL = "(" + ", ".join("'" + t.replace("'", "''") + "'" for t in NOISE_TERMS) + ")"

_POSTING_COLS = "job_url, title, company, location, posted_date, search_keyword, search_location"

def _keyword_snapshot_sql(source: str) -> str:
    """Keyword counts over ``source`` (job_url, description_text), by a
    list comprehension over the token list."""
    return f"""
  SELECT keyword, count(DISTINCT job_url) AS posting_count, DATE '{{snapshot_date}}' AS snapshot_date
  FROM (
    SELECT job_url, unnest(list_distinct(
             t
             || [t[i] || ' ' || t[i + 1] for i in range(1, len(t))]
             || [t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] for i in range(1, len(t) - 1)]
           )) AS keyword
    FROM (
      SELECT job_url,
             list_filter(regexp_split_to_array(lower(description_text), '{TOKEN_SPLIT}'),
                         lambda x: x <> '') AS t
      FROM {source}
      WHERE description_text IS NOT NULL AND job_url IS NOT NULL) tok
  ) grams
  GROUP BY keyword"""


_CTES = {
    "postings_raw": """
  SELECT CASE WHEN user_id % 20 = 7 THEN NULL ELSE 'job/' || CAST(user_id AS VARCHAR) END AS job_url,
         event_type AS title,
         'company ' || CAST(event_id % 13 AS VARCHAR) AS company,
         'city ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS location,
         CASE event_type WHEN 'view' THEN strftime(ts, '%Y-%m-%d')
                         WHEN 'click' THEN '3 days ago'
                         WHEN 'error' THEN '2024-02-31'
                         WHEN 'purchase' THEN '2024-1-5' END AS posted_date,
         props AS search_keyword,
         'area ' || CAST(event_id % 5 AS VARCHAR) AS search_location,
         ts AS scraped_at
  FROM events""",
    # The newest row of each key, as the value that goes with the largest order
    # (blanks stand for NULLs, which come first; no text here is blank).
    "postings_latest": f"""
  SELECT job_url, newest.* FROM (
    SELECT job_url, arg_max(
      {{'title': title, 'company': company, 'location': location, 'posted_date': posted_date,
        'search_keyword': search_keyword, 'search_location': search_location, 'scraped_at': scraped_at}},
      [strftime(scraped_at, '%Y-%m-%d %H:%M:%S.%f'), coalesce(title, ''), coalesce(company, ''), coalesce(location, ''),
       coalesce(posted_date, ''), coalesce(search_keyword, ''), coalesce(search_location, '')]) AS newest
    FROM postings_raw GROUP BY job_url)""",
    "posting_seen_dates": """
  SELECT job_url, title, company, location, TRY_CAST(posted_date AS DATE) AS posted_date,
         search_keyword, search_location,
         min(scraped_at) OVER (PARTITION BY job_url) AS first_seen_at,
         max(scraped_at) OVER (PARTITION BY job_url) AS last_seen_at
  FROM postings_latest""",
    "descriptions_raw": """
  SELECT 'job/' || CAST(p_partkey // 24 * 6 + p_partkey % 6 AS VARCHAR) AS job_url,
         CASE p_partkey % 6
           WHEN 0 THEN 'Needs ' || CAST(p_size % 25 AS VARCHAR) || '+ Years with ' || p_name
           WHEN 1 THEN CAST(p_size % 9 AS VARCHAR) || '-' || CAST(p_size % 9 + 2 AS VARCHAR) || ' years of ' || p_name
           WHEN 2 THEN 'about ' || CAST(p_size AS VARCHAR) || ' yrs ' || p_name
           WHEN 3 THEN '100 years of ' || p_name || ', ' || CAST(p_size % 12 AS VARCHAR) || ' year'
           WHEN 5 THEN 'the ' || p_name || ' team, no requirement'
         END AS description_text,
         CASE WHEN p_type = 'SMALL' THEN 'error'
              WHEN p_type = 'ECONOMY' AND p_size % 7 = 0 THEN NULL
              ELSE 'ok' END AS fetch_status
  FROM part""",
    "descriptions_ok": """
  SELECT job_url, description_text FROM descriptions_raw WHERE fetch_status = 'ok'""",
    # A left join as the postings that meet a description and those that meet none.
    "silver_postings": """
  SELECT s.*, d.description_text FROM posting_seen_dates s, descriptions_ok d WHERE s.job_url = d.job_url
  UNION ALL
  SELECT *, NULL FROM posting_seen_dates
  WHERE job_url IS NULL OR job_url NOT IN (SELECT job_url FROM descriptions_ok WHERE job_url IS NOT NULL)""",
    "year_mentions": f"""
  SELECT job_url, unnest([CAST(y AS INTEGER) for y in
    regexp_extract_all(lower(description_text), '{YEARS_PATTERN}', 1) if len(y) > 0]) AS years_val
  FROM silver_postings""",
    "min_years_per_posting": """
  SELECT job_url, min(years_val) AS years_min FROM year_mentions
  WHERE years_val BETWEEN 0 AND 20 GROUP BY job_url""",
    "experience_requirements": """
  SELECT s.job_url, (
    SELECT min(m.years_val) FROM year_mentions m
    WHERE m.job_url = s.job_url AND m.years_val >= 0 AND m.years_val <= 20) AS years_min
  FROM silver_postings s""",
    "experience_bands": """
  SELECT r.job_url, coalesce(b.label, 'not_specified') AS experience_band
  FROM experience_requirements r
  LEFT JOIN (VALUES (0, 2, '0-2'), (3, 5, '3-5'), (6, 8, '5-8'), (9, 20, '8+')) b(low, high, label)
    ON r.years_min BETWEEN b.low AND b.high""",
    "experience_distribution": """
  SELECT experience_band, count(*) AS posting_count,
         CAST(round(100.0 * count(*) / (SELECT count(*) FROM experience_bands), 1) AS DOUBLE) AS pct
  FROM experience_bands
  GROUP BY experience_band""",
    "described_total": """
  SELECT count(DISTINCT job_url) AS total_postings
  FROM silver_postings WHERE description_text IS NOT NULL""",
    "keyword_snapshots": """
  SELECT CASE event_type WHEN 'error' THEN 'security' WHEN 'signup' THEN 'k'
                         WHEN 'view' THEN 'View' ELSE event_type END AS keyword,
         count(DISTINCT user_id) AS posting_count,
         CAST(ts AS DATE) AS snapshot_date
  FROM events
  GROUP BY 1, 3""",
    "latest_snapshot_date": """
  SELECT max(snapshot_date) AS max_date FROM keyword_snapshots""",
    "keyword_denoised": f"""
  SELECT keyword, posting_count, snapshot_date FROM keyword_snapshots
  WHERE keyword NOT IN {_NOISE_SQL} AND length(keyword) > 1""",
    "keyword_denoised_table": """
  SELECT * FROM keyword_snapshots
  WHERE length(keyword) > 1 AND NOT EXISTS (
    SELECT 1 FROM events n
    WHERE CASE n.event_type WHEN 'error' THEN 'security' WHEN 'click' THEN 'click' END = keyword)""",
    "keyword_latest": """
  SELECT keyword, posting_count, snapshot_date,
         CAST(round(100.0 * posting_count / (SELECT total_postings FROM described_total), 1)
              AS DOUBLE) AS pct
  FROM keyword_denoised
  WHERE snapshot_date IN (SELECT max_date FROM latest_snapshot_date)""",
    "keyword_trends": """
  SELECT keyword, snapshot_date, posting_count,
         CAST(round(100.0 * posting_count / (SELECT total_postings FROM described_total), 1)
              AS DOUBLE) AS pct
  FROM keyword_denoised""",
    "descriptions_hot": """
  SELECT CASE WHEN p_partkey % 3 = 0 THEN 'job/8' ELSE job_url END AS job_url,
         CASE WHEN p_partkey % 97 = 0 THEN repeat(description_text || ' ', 200) ELSE description_text END AS description_text
  FROM ({descriptions_raw}, p_partkey FROM part) WHERE fetch_status = 'ok'""",
    "silver_postings_hot_key": """
  SELECT s.*, d.description_text
  FROM posting_seen_dates s LEFT JOIN descriptions_hot d ON s.job_url = d.job_url""",
    # Terms and texts as tokens between blanks: a term occurs where its run of
    # tokens does.
    "keyword_snapshot_vocabulary": f"""
  SELECT keyword, count(DISTINCT job_url) AS posting_count, DATE '{{snapshot_date}}' AS snapshot_date
  FROM (
    SELECT DISTINCT trim(regexp_replace(lower(unnest([p_name, 'The ' || p_name || ' Team, no'])),
                                        '{TOKEN_SPLIT}', ' ', 'g')) AS keyword FROM part) terms
  JOIN (
    SELECT DISTINCT job_url, ' ' || regexp_replace(lower(description_text), '{TOKEN_SPLIT}', ' ', 'g') || ' ' AS t
    FROM silver_postings WHERE description_text IS NOT NULL AND job_url IS NOT NULL) texts
  ON contains(t, ' ' || keyword || ' ')
  GROUP BY keyword""",
    "keyword_snapshot_long_vocabulary": f"""
  SELECT keyword, count(DISTINCT doc_id) AS posting_count, DATE '{{snapshot_date}}' AS snapshot_date
  FROM (
    SELECT DISTINCT unnest([array_to_string(t[1:12], ' '), t[1]]) AS keyword FROM (
      SELECT list_filter(regexp_split_to_array(lower(text), '{TOKEN_SPLIT}'), lambda x: x <> '') AS t FROM benchmark)) terms
  JOIN (
    SELECT doc_id, ' ' || regexp_replace(lower(text), '{TOKEN_SPLIT}', ' ', 'g') || ' ' AS t
    FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL) texts
  ON keyword <> '' AND contains(t, ' ' || keyword || ' ')
  GROUP BY keyword""",
    "documents_described": """
  SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS job_url, text AS description_text, 'ok' AS fetch_status
  FROM documents""",
    "keyword_snapshot": _keyword_snapshot_sql("documents_described"),
    "keyword_snapshot_postings": _keyword_snapshot_sql("silver_postings"),
}

_CTES["descriptions_hot"] = _CTES["descriptions_hot"].replace(
    "{descriptions_raw}", _CTES["descriptions_raw"].replace("\n  FROM part", ""))

# Which named steps each step reads (CTEs are emitted in dependency order).
_DEPS = {
    "postings_raw": [],
    "postings_latest": ["postings_raw"],
    "posting_seen_dates": ["postings_latest"],
    "descriptions_raw": [],
    "descriptions_ok": ["descriptions_raw"],
    "silver_postings": ["posting_seen_dates", "descriptions_ok"],
    "year_mentions": ["silver_postings"],
    "min_years_per_posting": ["year_mentions"],
    "experience_requirements": ["silver_postings", "min_years_per_posting"],
    "experience_bands": ["experience_requirements"],
    "experience_distribution": ["experience_bands"],
    "described_total": ["silver_postings"],
    "keyword_snapshots": [],
    "latest_snapshot_date": ["keyword_snapshots"],
    "keyword_denoised": ["keyword_snapshots"],
    "keyword_denoised_table": ["keyword_snapshots"],
    "keyword_latest": ["keyword_snapshots", "keyword_denoised", "described_total",
                       "latest_snapshot_date"],
    "keyword_trends": ["keyword_snapshots", "keyword_denoised", "described_total"],
    "descriptions_hot": [],
    "silver_postings_hot_key": ["posting_seen_dates", "descriptions_hot"],
    "keyword_snapshot_vocabulary": ["silver_postings"],
    "keyword_snapshot_long_vocabulary": [],
    "documents_described": [],
    "keyword_snapshot": ["documents_described"],
    "keyword_snapshot_postings": ["silver_postings"],
}


def _closure(name: str, seen: list[str]) -> list[str]:
    for dep in _DEPS[name]:
        _closure(dep, seen)
    if name not in seen:
        seen.append(name)
    return seen


def statement(name: str, final: str | None = None) -> str:
    """``WITH <upstream steps> <final select>`` for one named step."""
    steps = _closure(name, [])
    upstream = steps[:-1]
    body = final if final is not None else _CTES[name]
    if not upstream:
        return body.strip()
    ctes = ",\n".join(f"{s} AS ({_CTES[s]}\n)" for s in upstream)
    return f"WITH {ctes}\n{body.strip()}"


def model_statements(snapshot_date: str = "2024-01-31") -> dict[str, str]:
    """One statement per model step, excluding the raw bindings."""
    skip = {"postings_raw", "descriptions_raw", "descriptions_hot", "documents_described"}
    return {name: statement(name).replace("{snapshot_date}", snapshot_date)
            for name in _CTES if name not in skip}
