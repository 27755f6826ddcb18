"""Usage validation over the derived graph and usage, and over scripts built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartula.catalog import derived as dv
from chartula.catalog.graph_queries import _ATTRIBUTES, _FUNCTIONS, _METHODS
from chartula.catalog.registry import query
from chartula.operators import code_facts, usage_facts
from chartula.operators import usage_checks as uc
from chartula.operators import usage_reports as ur
from chartula.session import cut_lineage, shared_path
from chartula.sources import reports

# --- SQL statement of the rules -----------------------------------------------------------------------

_FOLD = """CASE WHEN lower(r.repo) = lower(m.module) THEN 1 WHEN replace(lower(r.repo), '-', '_') = lower(m.module) THEN 2
    WHEN replace(lower(r.repo), '_', '-') = lower(m.module) THEN 3 END"""
_WIDE = """CASE WHEN lower(r.repo) = lower(m.module) THEN 1 WHEN replace(lower(r.repo), '-', '_') = lower(m.module) THEN 2
    WHEN replace(lower(r.repo), '_', '-') = lower(m.module) OR contains(lower(r.repo), lower(m.module))
      OR contains(lower(m.module), replace(lower(r.repo), '-', '_')) THEN 3 END"""


def _best_sql(modules: str, fold: str) -> str:
    return f"""SELECT module, coalesce(max(repo) FILTER (WHERE kind = 0), max(repo) FILTER (WHERE kind = 1)) AS repo FROM (
        SELECT module, repo, 0 AS kind FROM (SELECT m.module, f.repo, row_number() OVER (PARTITION BY m.module ORDER BY count(*) DESC, f.repo) AS i
            FROM ({modules}) m JOIN ({dv.FILES}) f ON f.module_name = m.module OR starts_with(f.module_name, m.module || '.')
              OR split_part(f.module_name, '.', 1) = m.module GROUP BY m.module, f.repo) WHERE i = 1
        UNION ALL SELECT module, repo, 1 FROM (SELECT m.module, r.repo, row_number() OVER (PARTITION BY m.module ORDER BY {fold}, r.repo) AS i
            FROM ({modules}) m JOIN ({dv.REPOS}) r ON {fold} IS NOT NULL WHERE m.module <> '') WHERE i = 1) GROUP BY module"""


_HEAD = "left({o}, length({o}) - length(string_split({o}, '.')[-1]) - 1)"
_PRELUDE = f"""WITH methods AS ({_METHODS}), attributes AS ({_ATTRIBUTES}), functions AS ({_FUNCTIONS}),
    class_rows AS (SELECT DISTINCT repo, class_name, class_full_name FROM ({dv.CLASS_ROWS})),
    use_imports AS ({dv.USAGE_IMPORTS}), uses AS ({dv.USAGE}),
    best AS ({_best_sql("SELECT DISTINCT module FROM use_imports", _FOLD)}),
    imports AS (SELECT i.*, b.repo FROM use_imports i LEFT JOIN best b ON b.module = i.module),
    kg AS (SELECT DISTINCT script, split_part(module, '.', 1) AS base FROM imports WHERE repo IS NOT NULL),
    owners AS (SELECT DISTINCT owner, {_HEAD.format(o='owner')} AS module, string_split(owner, '.')[-1] AS simple FROM (
        SELECT owner FROM uses WHERE owner IS NOT NULL UNION ALL SELECT coalesce(function_full, function_name) FROM uses)),
    homes AS ({_best_sql("SELECT DISTINCT module FROM owners WHERE contains(owner, '.')", _WIDE)}),
    owned AS (SELECT o.*, h.repo FROM owners o LEFT JOIN homes h ON h.module = o.module AND contains(o.owner, '.')),
    u AS (SELECT uses.*, k.base IS NOT NULL AS in_graph FROM uses LEFT JOIN kg k ON k.script = uses.script AND k.base = split_part(owner, '.', 1)),
    fu AS (SELECT uses.*, k.base IS NOT NULL AS in_graph FROM uses LEFT JOIN kg k ON k.script = uses.script AND k.base = split_part(function_full, '.', 1)),
    mkeys AS (SELECT DISTINCT owner, member FROM uses WHERE owner IS NOT NULL),
    mfound AS (SELECT k.owner, k.member,
        (SELECT arg_min(params, class_full_name) FROM methods m WHERE (m.class_name = k.owner OR m.class_full_name = k.owner) AND m.name = k.member) AS exact,
        (SELECT arg_min(params, m.class_full_name) FROM methods m JOIN class_rows c ON c.class_full_name = m.class_full_name
           WHERE c.repo = o.repo AND m.class_name = o.simple AND m.name = k.member) AS indirect
        FROM mkeys k JOIN owned o ON o.owner = k.owner),
    afound AS (SELECT k.owner, k.member,
        (SELECT arg_min(type, class_full_name) FROM attributes m WHERE (m.class_name = k.owner OR m.class_full_name = k.owner) AND m.name = k.member) AS exact,
        (SELECT arg_min(type, m.class_full_name) FROM attributes m JOIN class_rows c ON c.class_full_name = m.class_full_name
           WHERE c.repo = o.repo AND m.class_name = o.simple AND m.name = k.member) AS indirect
        FROM mkeys k JOIN owned o ON o.owner = k.owner),
    cfound AS (SELECT o.owner, EXISTS (SELECT 1 FROM class_rows c WHERE c.class_name = o.owner OR c.class_full_name = o.owner
        OR (c.repo = o.repo AND c.class_name = o.simple)) AS found FROM owned o),
    ffound AS (SELECT o.owner,
        (SELECT arg_min(params, full_name || '|' || repo || '|' || path) FROM functions f WHERE f.name = o.owner OR f.full_name = o.owner) AS exact,
        (SELECT arg_min(params, full_name || '|' || repo || '|' || path) FROM functions f WHERE f.repo = o.repo AND f.name = o.simple) AS indirect FROM owned o)
    """


def _check_sql(params: str) -> str:
    """Status of the call check for rendered parameters joined by bars."""
    return f"""CASE WHEN {params} IS NULL OR {params} = '' THEN 'UNCERTAIN'
        WHEN NOT contains({params}, '[var_positional]') AND n_args > len(list_filter(string_split({params}, '|'), lambda p: p[1:1] <> '[')) THEN 'INVALID'
        WHEN n_args < len(list_filter(string_split({params}, '|'), lambda p: p[1:1] <> '[' AND NOT contains(p, '='))) THEN 'INVALID'
        WHEN NOT contains({params}, '[var_keyword]') AND (kw = 2 OR (kw = 1 AND NOT contains({params}, 'b:str'))) THEN 'INVALID'
        WHEN contains({params}, '[keyword_only] k') AND kw <> 2 THEN 'INVALID' ELSE 'VALID' END"""


def _confidence_sql(params: str) -> str:
    return f"""CASE WHEN NOT contains({params}, '[var_positional]') AND n_args > len(list_filter(string_split({params}, '|'), lambda p: p[1:1] <> '[')) THEN 0.8
        WHEN n_args < len(list_filter(string_split({params}, '|'), lambda p: p[1:1] <> '[' AND NOT contains(p, '='))) THEN 0.8
        WHEN NOT contains({params}, '[var_keyword]') AND (kw = 2 OR (kw = 1 AND NOT contains({params}, 'b:str'))) THEN 0.7 ELSE 0.8 END"""


_IMPORT_SQL = """SELECT script, 'import' AS kind, seq, line, name, module AS owner, repo IS NOT NULL AS in_graph,
    CASE WHEN repo IS NULL THEN 'UNCERTAIN' ELSE 'VALID' END AS status, CAST(CASE WHEN repo IS NULL THEN 0.8 ELSE 0.9 END AS DOUBLE) AS confidence,
    CAST(NULL AS VARCHAR) AS param_status FROM imports"""
_CLASS_SQL = """SELECT script, 'class' AS kind, seq, line, string_split(u.owner, '.')[-1] AS name, u.owner, in_graph,
    CASE WHEN NOT in_graph THEN 'UNCERTAIN' WHEN NOT c.found THEN 'NOT_FOUND' ELSE 'VALID' END AS status,
    CAST(CASE WHEN NOT in_graph THEN 0.8 WHEN NOT c.found THEN 0.2 ELSE 0.8 END AS DOUBLE) AS confidence,
    CASE WHEN in_graph AND c.found THEN 'UNCERTAIN' END AS param_status
    FROM u JOIN cfound c ON c.owner = u.owner WHERE u.kind = 2 AND u.owner IS NOT NULL"""
_METHOD_SQL = f"""SELECT script, 'method' AS kind, seq, line, member AS name, owner, in_graph, CASE WHEN owner IS NULL THEN 'UNCERTAIN'
        WHEN NOT in_graph THEN 'UNCERTAIN' WHEN p IS NULL THEN 'NOT_FOUND' WHEN s = 'INVALID' THEN 'INVALID' ELSE 'VALID' END AS status,
    CAST(CASE WHEN owner IS NULL THEN 0.3 WHEN NOT in_graph THEN 0.8 WHEN p IS NULL THEN 0.1 WHEN s = 'INVALID' THEN c ELSE 0.9 END AS DOUBLE) AS confidence,
    CASE WHEN in_graph AND p IS NOT NULL THEN s END AS param_status
    FROM (SELECT *, {_check_sql('p')} AS s, {_confidence_sql('p')} AS c FROM (
        SELECT u.*, coalesce(f.exact, f.indirect) AS p FROM u LEFT JOIN mfound f ON f.owner = u.owner AND f.member = u.member WHERE kind = 0))"""
_ATTRIBUTE_SQL = """SELECT script, 'attribute' AS kind, seq, line, u.member AS name, u.owner, in_graph, CASE WHEN u.owner IS NULL THEN 'UNCERTAIN'
        WHEN NOT in_graph THEN 'UNCERTAIN' WHEN coalesce(a.exact, a.indirect, m.exact, m.indirect) IS NULL THEN 'NOT_FOUND' ELSE 'VALID' END AS status,
    CAST(CASE WHEN u.owner IS NULL THEN 0.3 WHEN NOT in_graph THEN 0.8 WHEN coalesce(a.exact, a.indirect, m.exact, m.indirect) IS NULL THEN 0.2 ELSE 0.8 END AS DOUBLE) AS confidence,
    CAST(NULL AS VARCHAR) AS param_status
    FROM u LEFT JOIN afound a ON a.owner = u.owner AND a.member = u.member LEFT JOIN mfound m ON m.owner = u.owner AND m.member = u.member WHERE u.kind = 1"""
_FUNCTION_SQL = f"""SELECT script, 'function' AS kind, seq, line, function_name AS name, o AS owner, in_graph,
    CASE WHEN function_full IS NOT NULL AND NOT in_graph THEN 'UNCERTAIN' WHEN p IS NULL THEN 'NOT_FOUND' WHEN s = 'INVALID' THEN 'INVALID' ELSE 'VALID' END AS status,
    CAST(CASE WHEN function_full IS NOT NULL AND NOT in_graph THEN 0.8 WHEN p IS NULL THEN 0.2 WHEN s = 'INVALID' THEN c ELSE 0.8 END AS DOUBLE) AS confidence,
    CASE WHEN (function_full IS NULL OR in_graph) AND p IS NOT NULL THEN s END AS param_status
    FROM (SELECT *, {_check_sql('p')} AS s, {_confidence_sql('p')} AS c FROM (
        SELECT fu.*, coalesce(function_full, function_name) AS o, coalesce(f.exact, f.indirect) AS p
        FROM fu LEFT JOIN ffound f ON f.owner = coalesce(function_full, function_name) WHERE kind = 3))"""
_ALL_SQL = " UNION ALL ".join([_IMPORT_SQL, _CLASS_SQL, _METHOD_SQL, _ATTRIBUTE_SQL, _FUNCTION_SQL])
_SHOWN = ["script", "kind", "seq", "line", "name", "owner", "in_graph", "status", "confidence", "param_status"]


def _validated(t):
    rows, _ = uc.validate(dv.usage(t), dv.graph(t))
    return cut_lineage(rows)


def _graph(t, *members):
    """The derived graph with the tables that lookups read repeatedly kept."""
    return dv.graph(t).materialised("repositories", "files", "class_files", *members)


def _modules(t, graph):
    return uc.graph_modules(uc.check_imports(dv.usage(t).imports, graph))


@query(
    "module_repositories",
    _PRELUDE + "SELECT module, repo FROM best WHERE repo IS NOT NULL",
)
def module_repositories(t):
    modules = dv.usage(t).imports.select("module").distinct()
    return uc.best_repository(modules, dv.graph(t)).select("module", "repo")


@query(
    "module_repositories_ranked",
    f"""WITH m AS (SELECT DISTINCT module FROM ({dv.USAGE_IMPORTS})),
    a AS (SELECT m.module, f.repo, 0 AS kind, row_number() OVER (PARTITION BY m.module ORDER BY count(*) DESC, f.repo) AS i
        FROM m JOIN ({dv.FILES}) f ON f.module_name = m.module OR starts_with(f.module_name, m.module || '.') OR split_part(f.module_name, '.', 1) = m.module
        GROUP BY m.module, f.repo),
    b AS (SELECT m.module, r.repo, 1 AS kind, row_number() OVER (PARTITION BY m.module ORDER BY {_FOLD}, r.repo) AS i FROM m JOIN ({dv.REPOS}) r ON {_FOLD} IS NOT NULL),
    x AS (SELECT module, repo, min(kind * 10 + i) AS place FROM (SELECT * FROM a WHERE i <= 5 UNION ALL SELECT * FROM b WHERE i <= 5) GROUP BY module, repo)
    SELECT module, repo, CAST(row_number() OVER (PARTITION BY module ORDER BY place, repo) AS INTEGER) AS rank FROM x""",
)
def module_repositories_ranked(t):
    modules = dv.usage(t).imports.select("module").distinct()
    return uc.ranked_repositories(modules, dv.graph(t)).select("module", "repo", "rank")


@query(
    "similar_modules",
    f"""WITH m AS (SELECT DISTINCT module FROM ({dv.USAGE_IMPORTS}) UNION SELECT DISTINCT left(upper(n_name), 2) FROM nation
          UNION SELECT lower(left(r_name, 4)) FROM region),
    s AS (SELECT m.module, r.repo, row_number() OVER (PARTITION BY m.module ORDER BY r.repo) AS i FROM m JOIN ({dv.REPOS}) r
          ON contains(lower(r.repo), lower(left(m.module, 3))) OR contains(replace(lower(r.repo), '-', '_'), lower(left(m.module, 3)))
          OR contains(replace(lower(r.repo), '_', '-'), lower(left(m.module, 3))))
    SELECT module, string_agg(repo, ',' ORDER BY repo) AS suggestions FROM s WHERE i <= 5 GROUP BY module""",
)
def similar_modules(t):
    modules = (
        dv.usage(t).imports.select("module")
        .union(t.nation.select(F.left(F.upper("n_name"), F.lit(2))))
        .union(t.region.select(F.lower(F.left("r_name", F.lit(4)))))
        .distinct()
    )
    rows = uc.similar_modules(modules, dv.graph(t).repositories)
    return rows.withColumn("suggestions", F.array_join("suggestions", ","))


@query(
    "check_imports",
    _PRELUDE + """SELECT script, seq, module, repo, CASE WHEN repo IS NULL THEN 'UNCERTAIN' ELSE 'VALID' END AS status,
        CAST(CASE WHEN repo IS NULL THEN 0.8 ELSE 0.9 END AS DOUBLE) AS confidence FROM imports""",
)
def check_imports(t):
    rows = uc.check_imports(dv.usage(t).imports, dv.graph(t))
    return rows.select("script", "seq", "module", "repo", "status", "confidence")


@query(
    "module_contents",
    _PRELUDE + """SELECT DISTINCT b.module AS search_module, 'class' AS kind, c.class_name AS name FROM best b JOIN class_rows c ON c.repo = b.repo
        UNION SELECT DISTINCT b.module, 'function', f.name FROM best b JOIN functions f ON f.repo = b.repo""",
)
def module_contents(t):
    graph = _graph(t)
    return uc.module_contents(uc.check_imports(dv.usage(t).imports, graph), graph)


@query("graph_modules", _PRELUDE + "SELECT script, base FROM kg")
def graph_modules(t):
    return _modules(t, dv.graph(t))


@query("check_instantiations", _PRELUDE + _CLASS_SQL)
def check_instantiations(t):
    graph = _graph(t, "classes", "methods")
    return uc.check_instantiations(dv.usage(t).instantiations, _modules(t, graph), graph).select(*_SHOWN)


@query("check_method_calls", _PRELUDE + _METHOD_SQL)
def check_method_calls(t):
    graph = _graph(t, "methods")
    return uc.check_method_calls(dv.usage(t).method_calls, _modules(t, graph), graph).select(*_SHOWN)


@query(
    "method_suggestions",
    _PRELUDE
    + f""", miss AS (SELECT DISTINCT owner, name FROM ({_METHOD_SQL}) WHERE status = 'NOT_FOUND'),
    d AS (SELECT DISTINCT x.owner, x.name, m.name AS candidate FROM miss x JOIN methods m ON (m.class_name = x.owner OR m.class_full_name = x.owner)
          AND contains(m.name, left(x.name, 3))),
    r AS (SELECT DISTINCT x.owner, x.name, m.name AS candidate FROM miss x JOIN owned o ON o.owner = x.owner JOIN class_rows c ON c.repo = o.repo AND c.class_name = o.simple
          JOIN methods m ON m.class_full_name = c.class_full_name AND contains(m.name, left(x.name, 3))
          WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.owner = x.owner AND d.name = x.name)),
    s AS (SELECT *, row_number() OVER (PARTITION BY owner, name ORDER BY candidate) AS i FROM (SELECT * FROM d UNION ALL SELECT * FROM r))
    SELECT owner, name, string_agg(candidate, ',' ORDER BY candidate) AS suggestions FROM s WHERE i <= 5 GROUP BY owner, name""",
)
def method_suggestions(t):
    graph = _graph(t, "methods")
    rows = uc.check_method_calls(dv.usage(t).method_calls, _modules(t, graph), graph)
    rows = rows.filter("status = 'NOT_FOUND' AND size(suggestions) > 0").select("owner", "name", "suggestions").distinct()
    return rows.withColumn("suggestions", F.array_join("suggestions", ","))


@query("check_attributes", _PRELUDE + _ATTRIBUTE_SQL)
def check_attributes(t):
    graph = _graph(t, "methods", "attributes")
    return uc.check_attributes(dv.usage(t).attributes, _modules(t, graph), graph).select(*_SHOWN)


@query("check_functions", _PRELUDE + _FUNCTION_SQL)
def check_functions(t):
    graph = _graph(t, "functions")
    return uc.check_functions(dv.usage(t).functions, _modules(t, graph), graph).select(*_SHOWN)


_PARAMS_SQL = dv._params("o_orderkey")


@query(
    "check_call",
    f"SELECT o_orderkey, {_check_sql('p')} AS status FROM (SELECT o_orderkey, {_PARAMS_SQL} AS p, o_custkey % 4 AS n_args, CAST(o_orderkey // 5 AS BIGINT) % 3 AS kw FROM orders)",
)
def check_call(t):
    from chartula.functions import params as pm

    rows = t.sql(
        f"SELECT o_orderkey, {_PARAMS_SQL} AS params, o_custkey % 4 AS n_args, CAST(floor(o_orderkey / 5) AS BIGINT) % 3 AS kw FROM orders", "orders"
    )
    args = F.slice(F.array(F.lit("1"), F.lit("2"), F.lit("3")), 1, F.col("n_args").cast("int"))
    kwargs = F.when(F.col("kw") == 1, F.create_map(F.lit("b"), F.lit("1"))).when(
        F.col("kw") == 2, F.create_map(F.lit("k"), F.lit("1"), F.lit("zz"), F.lit("2"))
    )
    check = pm.check_call(dv._listed(), args, kwargs)
    return rows.select("o_orderkey", check["status"].alias("status"))


@query(
    "result_methods",
    _PRELUDE
    + """SELECT m.name, arg_min(m.class_name, m.class_full_name) AS class_name, arg_min(m.return_type, m.class_full_name) AS return_type
        FROM methods m JOIN (SELECT DISTINCT class_full_name FROM class_rows WHERE repo = 'asia') c USING (class_full_name)
        WHERE contains(m.class_name, '7') OR contains(m.class_name, '9') GROUP BY m.name""",
)
def result_methods(t):
    """First method of each name on the classes of one repository with given name parts."""
    graph = dv.graph(t)
    rows = uc.find_result_methods(graph.methods.select("name"), graph, "asia", parts=("7", "9"))
    return rows.select("name", "class_name", "return_type")


# --- scores and reports ----------------------------------------------------------------------------------

_CONFIDENCE_SQL = f"""SELECT s.script, coalesce(avg(confidence) FILTER (WHERE in_graph), 1.0) AS overall_confidence
    FROM (SELECT DISTINCT script FROM uses) s LEFT JOIN ({_ALL_SQL}) v ON v.script = s.script GROUP BY s.script"""
_FIRST_SQL = """SELECT script, line, name, owner, min(CASE WHEN kind = 'method' THEN 0 ELSE 1 END) AS k, arg_min(status, CASE WHEN kind = 'method' THEN 0 ELSE 1 END) AS status
    FROM v WHERE in_graph AND kind IN ('method', 'attribute'){more} GROUP BY script, line, name, owner"""
_FINDINGS_SQL = f"""SELECT script, line, CASE WHEN k = 0 THEN 'METHOD_NOT_FOUND' ELSE 'ATTRIBUTE_NOT_FOUND' END AS type, name
    FROM ({_FIRST_SQL.format(more=" AND status = 'NOT_FOUND'")})
    UNION ALL SELECT script, line, 'INVALID_PARAMETERS', name FROM v WHERE in_graph AND kind = 'method' AND param_status = 'INVALID'"""
_SUMMARY_SQL = f"""SELECT s.script, count(i.status) AS total_validations, count(*) FILTER (WHERE i.status = 'VALID') AS valid_count,
        count(*) FILTER (WHERE i.status = 'INVALID') AS invalid_count, count(*) FILTER (WHERE i.status = 'UNCERTAIN') AS uncertain_count,
        count(*) FILTER (WHERE i.status = 'NOT_FOUND') AS not_found_count
    FROM (SELECT DISTINCT script FROM uses) s LEFT JOIN (SELECT script, status FROM v WHERE in_graph AND kind NOT IN ('method', 'attribute')
        UNION ALL SELECT script, status FROM ({_FIRST_SQL.format(more='')})) i ON i.script = s.script GROUP BY s.script"""
_RATE_SQL = f"""SELECT *, round((invalid_count + not_found_count) / greatest(1, valid_count + invalid_count + not_found_count), 6) AS hallucination_rate FROM ({_SUMMARY_SQL})"""
_V = _PRELUDE + f", v AS ({_ALL_SQL}) "


@query("overall_confidence", _PRELUDE + f"SELECT script, round(overall_confidence, 6) AS overall_confidence FROM ({_CONFIDENCE_SQL})")
def overall_confidence(t):
    rows = ur.overall_confidence(dv.usage(t).scripts, _validated(t))
    return rows.withColumn("overall_confidence", F.round("overall_confidence", 6))


@query("findings", _V + _FINDINGS_SQL)
def findings(t):
    rows = ur.findings(_validated(t))
    return rows.select("script", "line", "type", "name")


@query("validation_summary", _V + _RATE_SQL)
def validation_summary(t):
    rows = ur.validation_summary(dv.usage(t).scripts, _validated(t))
    return rows.withColumn("hallucination_rate", F.round("hallucination_rate", 6))


_LIBRARY_SQL = f"""SELECT v.script, v.kind, v.seq, v.name, m.module FROM v
    JOIN (SELECT DISTINCT script, owner AS module FROM v WHERE kind = 'import') m ON m.script = v.script
      AND v.kind <> 'import' AND contains(v.owner, '.') AND m.module = {_HEAD.format(o='v.owner')}
    UNION ALL SELECT script, 'import', min(seq), NULL, owner FROM v WHERE kind = 'import' GROUP BY script, owner"""


@query("library_usage", _V + _LIBRARY_SQL)
def library_usage(t):
    return ur.library_usage(_validated(t)).select("script", "kind", "seq", "name", "module")


_FOUND_COUNTS = f"""SELECT s.script, count(f.type) AS hallucinations, count(*) FILTER (WHERE type = 'METHOD_NOT_FOUND') AS m,
    count(*) FILTER (WHERE type = 'ATTRIBUTE_NOT_FOUND') AS a, count(*) FILTER (WHERE type = 'INVALID_PARAMETERS') AS p
    FROM (SELECT DISTINCT script FROM uses) s LEFT JOIN ({_FINDINGS_SQL}) f ON f.script = s.script GROUP BY s.script"""


@query(
    "recommendations",
    _V
    + f"""SELECT c.script, array_to_string(list_filter([
        CASE WHEN m > 0 THEN m || ' {ur.ADVICE["METHOD_NOT_FOUND"]}' END, CASE WHEN a > 0 THEN a || ' {ur.ADVICE["ATTRIBUTE_NOT_FOUND"]}' END,
        CASE WHEN p > 0 THEN p || ' {ur.ADVICE["INVALID_PARAMETERS"]}' END, CASE WHEN m + a + p = 0 THEN '{ur.NO_FINDINGS}' END,
        CASE WHEN overall_confidence < 0.7 THEN '{ur.LOW_CONFIDENCE}' END], lambda x: x IS NOT NULL), '; ') AS recommendations
        FROM ({_FOUND_COUNTS}) c JOIN ({_CONFIDENCE_SQL}) o ON o.script = c.script""",
)
def recommendations(t):
    scripts, rows = dv.usage(t).scripts, _validated(t)
    advice = ur.recommendations(scripts, ur.findings(rows), ur.overall_confidence(scripts, rows))
    return advice.withColumn("recommendations", F.array_join("recommendations", "; "))


@query(
    "batch_summary",
    _V
    + f"""SELECT count(*) AS total_scripts, CAST(sum(total_validations) AS BIGINT) AS total_validations, CAST(sum(valid_count) AS BIGINT) AS total_valid,
        CAST(sum(invalid_count) AS BIGINT) AS total_invalid, CAST(sum(not_found_count) AS BIGINT) AS total_not_found,
        CAST(sum(hallucinations) AS BIGINT) AS total_hallucinations, round(avg(overall_confidence), 6) AS average_confidence
        FROM ({_SUMMARY_SQL}) s JOIN ({_FOUND_COUNTS}) c ON c.script = s.script JOIN ({_CONFIDENCE_SQL}) o ON o.script = s.script""",
)
def batch_summary(t):
    reports = ur.script_reports(dv.usage(t).scripts, _validated(t))
    return ur.batch_summary(reports).withColumn("average_confidence", F.round("average_confidence", 6))


@query(
    "worst_scripts",
    _V
    + f"""SELECT c.script, hallucinations, round(overall_confidence, 6) AS overall_confidence FROM ({_FOUND_COUNTS}) c
        JOIN ({_CONFIDENCE_SQL}) o ON o.script = c.script ORDER BY hallucinations DESC, c.script LIMIT 5""",
)
def worst_scripts(t):
    reports = ur.script_reports(dv.usage(t).scripts, _validated(t))
    return ur.worst_scripts(reports).withColumn("overall_confidence", F.round("overall_confidence", 6))


@query(
    "report_items",
    _V
    + f"""SELECT script, kind, line, name, status FROM v WHERE in_graph AND kind NOT IN ('method', 'attribute')
        UNION ALL SELECT script, CASE WHEN k = 0 THEN 'method' ELSE 'attribute' END, line, name, status FROM ({_FIRST_SQL.format(more='')})""",
)
def report_items(t):
    return ur.report_items(_validated(t)).select("script", "kind", "line", "name", "status")


_KIND_COUNTS = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS total_{k}s" for k in ur.KINDS)


@query(
    "script_reports",
    _V
    + f"""SELECT s.*, {", ".join(f"coalesce(k.total_{k}s, 0) AS total_{k}s" for k in ur.KINDS)}, c.hallucinations, round(o.overall_confidence, 6) AS overall_confidence
        FROM ({_RATE_SQL}) s JOIN ({_FOUND_COUNTS}) c ON c.script = s.script JOIN ({_CONFIDENCE_SQL}) o ON o.script = s.script
        LEFT JOIN (SELECT script, {_KIND_COUNTS} FROM v GROUP BY script) k ON k.script = s.script""",
)
def script_reports(t):
    """Report heads (the advice is compared in ``recommendations``)."""
    reports = ur.script_reports(dv.usage(t).scripts, _validated(t)).drop("recommendations")
    return reports.withColumns({c: F.round(c, 6) for c in ("hallucination_rate", "overall_confidence")})


# --- from source text --------------------------------------------------------------------------------------


def script_files(t):
    """One script per customer, written from its columns; some do not parse."""
    key = F.col("c_custkey")
    text = F.concat(
        F.lit("import numpy as np\nfrom shop.base import Thing as T, helper\n\nthing = T("),
        key,
        F.lit(", name='x')\nresult = thing.load("),
        key,
        F.lit(")\nresult.show()\nnp.array([1])\nhelper(thing, flag=True)\nprint(thing.size)\nwith thing.open() as handle:\n    handle.read()\n"),
        F.lit("other.call()\nother = Widget"),
        key % 10,
        F.lit("()\n"),
    )
    return t.customer.select(
        F.concat(F.lit("script"), key).alias("script"),
        F.when(key % 50 == 9, F.concat(text, F.lit("x ="))).otherwise(text).alias("content"),
    )


@query(
    "typed_method_calls",
    """SELECT 'script' || c_custkey AS script, x.line, x.object_name, x.method_name,
           CASE WHEN x.object_type = 'Widget' THEN 'Widget' || (c_custkey % 10) ELSE x.object_type END AS object_type
       FROM customer, (VALUES (5, 'thing', 'load', 'shop.base.Thing'), (6, 'result', 'show', 'method_result'), (7, 'np', 'array', NULL),
           (10, 'thing', 'open', 'shop.base.Thing'), (11, 'handle', 'read', 'context_manager_result'), (12, 'other', 'call', 'Widget'))
           AS x(line, object_name, method_name, object_type) WHERE c_custkey % 50 <> 9""",
)
def typed_method_calls(t):
    usage = usage_facts.usage_tables(cut_lineage(code_facts.extract_usage(script_files(t))))
    return usage.method_calls.select("script", "line", "object_name", "method_name", "object_type")


@query(
    "resolved_calls",
    """SELECT 'script' || c_custkey AS script, x.line, CASE WHEN x.name = 'Widget' THEN 'Widget' || (c_custkey % 10) ELSE x.name END AS name, x.full_name, x.kind
       FROM customer, (VALUES (4, 'T', 'shop.base.Thing', 'class'), (8, 'helper', 'shop.base.helper', 'function'), (9, 'print', NULL, 'function'),
           (13, 'Widget', NULL, 'class')) AS x(line, name, full_name, kind) WHERE c_custkey % 50 <> 9""",
)
def resolved_calls(t):
    usage = usage_facts.usage_tables(cut_lineage(code_facts.extract_usage(script_files(t))))
    made = usage.instantiations.select(
        "script", "line", F.col("class_name").alias("name"), F.col("full_class_name").alias("full_name"), F.lit("class").alias("kind")
    )
    called = usage.functions.select(
        "script", "line", F.col("function_name").alias("name"), "full_name", F.lit("function").alias("kind")
    )
    return made.union(called)


@query("report_sink", _V + f"SELECT 'findings' AS part, script, CAST(line AS BIGINT) AS line, type AS what, name FROM ({_FINDINGS_SQL}) UNION ALL SELECT 'reports', script, NULL, CAST(total_validations AS VARCHAR), NULL FROM ({_SUMMARY_SQL})")
def report_sink(t):
    """Reports written as JSON lines and read back."""
    scripts, rows = dv.usage(t).scripts, _validated(t)
    folder = shared_path(t.spark, "reports")
    reports.write_reports(ur.script_reports(scripts, rows), rows, folder)
    found = t.spark.read.schema("script string, line long, type string, name string").json(f"{folder}/findings")
    heads = t.spark.read.schema("script string, total_validations long").json(f"{folder}/reports")
    return found.select(F.lit("findings").alias("part"), "script", "line", F.col("type").alias("what"), "name").unionByName(
        heads.select(F.lit("reports").alias("part"), "script", F.lit(None).cast("long").alias("line"), F.col("total_validations").cast("string").alias("what"), F.lit(None).cast("string").alias("name"))
    )
