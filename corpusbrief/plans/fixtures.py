"""Views of the test tables in the shapes of the corpus: files, history, events, requests, outputs.

The SQL is the same for Spark and for the engine that checks it, but for two names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = """
SELECT doc_id, lang AS repo_id,
  CASE doc_id % 20
    WHEN 0 THEN 'pkg'||doc_id||'/README.md'        WHEN 1 THEN 'src/m'||doc_id||'.py'
    WHEN 2 THEN 'src/M'||doc_id||'.PY'             WHEN 3 THEN 'lib/a/b'||doc_id||'.js'
    WHEN 4 THEN 'lib/app'||doc_id||'.min.js'       WHEN 5 THEN 'web/s'||doc_id||'.min.css'
    WHEN 6 THEN 'svc'||doc_id||'/Dockerfile'       WHEN 7 THEN 'svc'||doc_id||'/Cargo.lock'
    WHEN 8 THEN 'node_modules/p'||doc_id||'/i.js'  WHEN 9 THEN 'Docs/z'||doc_id||'.md'
    WHEN 10 THEN '.github/w'||doc_id||'.yml'       WHEN 11 THEN 'cfg'||doc_id||'/.env.example'
    WHEN 12 THEN 'pkg'||doc_id||'/__init__.py'     WHEN 13 THEN 'notes/n'||doc_id||'.txt'
    WHEN 14 THEN 'img/i'||doc_id||'.png'           WHEN 15 THEN 'bin/tool'||doc_id
    WHEN 16 THEN 'src/x'||doc_id||'.go'            WHEN 17 THEN 'pkg'||doc_id||'/package.json'
    WHEN 18 THEN 'src/y'||doc_id||'.ts'            ELSE 'v'||doc_id||'/LICENSE' END AS path,
  {BYTES}(text) AS size, text AS content
FROM {documents}
"""

HISTORY = """
SELECT event_id + 1 AS id,
  CASE WHEN user_id % 10 = 0 THEN NULL ELSE CAST(user_id AS {STR}) END AS user_id,
  'https://github.com/u'||user_id||'/r'||(event_id % 7) AS repository_url,
  ts AS created_at, ts AS updated_at,
  CASE event_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'es' WHEN 2 THEN 'fr' ELSE 'de' END AS lang,
  CASE event_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS size,
  CASE event_id % 3 WHEN 0 THEN 'expert' WHEN 1 THEN 'technical' ELSE 'non-technical' END AS technicality,
  CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'QUEUED' ELSE 'PROCESSING' END AS status,
  CASE WHEN event_type = 'purchase' AND event_id % 5 <> 0 THEN 'summary '||event_id END AS summary,
  CASE WHEN event_type = 'error' AND event_id % 5 <> 0 THEN 'error '||event_id END AS error
FROM {events}
"""

STATUS_EVENTS = """
SELECT event_id AS seq, ts,
  CASE WHEN event_id % 3 = 0 THEN event_id % 7 WHEN event_id % 13 = 5 THEN 1000000000 + event_id
       ELSE event_id - event_id % 8 + 1 END AS analysis_id,
  CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'PROCESSING'
       WHEN 'view' THEN CASE WHEN event_id % 11 = 0 THEN 'completed' ELSE 'PROCESSING' END
       ELSE CASE WHEN event_id % 2 = 0 THEN '' END END AS status,
  CASE WHEN event_id % 5 <> 0 THEN 's'||event_id END AS summary,
  CASE WHEN event_id % 3 <> 0 THEN 'e'||event_id END AS error
FROM {events}
"""

REQUESTS = """
SELECT page_id AS request_id,
  CASE page_id % 8 WHEN 0 THEN 'https://github.com/own'||page_id||'/repo'||page_id||'.git'
    WHEN 1 THEN 'git@host.example:own'||page_id||'/my.github.io.git'
    WHEN 2 THEN 'https://GitHub.com/own'||page_id||'/r/tree/main?x=1#f'
    WHEN 3 THEN 'https://tok'||page_id||'@github.com/o/r'
    WHEN 4 THEN 'https://github.com/only'||page_id
    WHEN 5 THEN 'git@bad'||page_id
    WHEN 6 THEN 'https://github.com/o//r'
    ELSE url END AS url,
  CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'es' ELSE 'en' END AS lang,
  CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'SMALL' WHEN 2 THEN 'large' WHEN 3 THEN 'huge' ELSE 'medium' END AS size,
  CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ' Beginner ' WHEN 2 THEN 'intermediate' WHEN 3 THEN 'EXPERT' WHEN 4 THEN 'weird' WHEN 5 THEN '' ELSE 'non-technical' END AS technicality
FROM {pages}
"""

MODEL_OUTPUTS = """
SELECT conv_id, turn, text,
  CASE (conv_id + turn) % 4 WHEN 0 THEN '```html'||chr(10)||text||chr(10)||'```'
    WHEN 1 THEN '  ```'||text||'```  ' WHEN 2 THEN chr(9)||text||chr(10) ELSE '```HTML '||text END AS output
FROM {conversations} WHERE role = 'assistant'
"""

VIEWS = {
    "files": FILES,
    "history": HISTORY,
    "status_events": STATUS_EVENTS,
    "requests": REQUESTS,
    "model_outputs": MODEL_OUTPUTS,
}

_TABLES = ("documents", "events", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the parquet tables; only the columns a query uses are read."""
    sql = VIEWS[name].replace("{BYTES}", "octet_length").replace("{STR}", "STRING")
    used = {t: table(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def view_of(df: DataFrame, name: str) -> DataFrame:
    """A view over one given frame, batch or streaming, in place of its table."""
    sql = VIEWS[name].replace("{BYTES}", "octet_length").replace("{STR}", "STRING")
    return df.sparkSession.sql(sql, **{t: df for t in _TABLES if "{" + t + "}" in sql})


def check_view(name: str) -> str:
    """The same view for the checking engine, as the body of a WITH entry."""
    sql = VIEWS[name].replace("{BYTES}", "strlen").replace("{STR}", "VARCHAR")
    for t in _TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
