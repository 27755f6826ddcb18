"""Code-graph queries over the derived graph and over source text built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartula.catalog import derived as dv
from chartula.catalog.registry import query
from chartula.functions import params as pm
from chartula.operators import code_facts
from chartula.operators import code_graph as cg
from chartula.session import cut_lineage
from chartula.sources import repo_files, tables

_METHODS = f"""SELECT class_full_name, any_value(class_name) AS class_name, name, arg_min(params, ord) AS params,
    arg_min(return_type, ord) AS return_type FROM ({dv.METHOD_ROWS}) GROUP BY class_full_name, name"""
_ATTRIBUTES = f"""SELECT class_full_name, any_value(class_name) AS class_name, name, arg_min(type, ord) AS type
    FROM ({dv.ATTRIBUTE_ROWS}) GROUP BY class_full_name, name"""
_FUNCTIONS = f"""SELECT repo, path, name, any_value(full_name) AS full_name, arg_min(params, ord) AS params
    FROM ({dv.FUNCTION_ROWS}) GROUP BY repo, path, name"""


@query(
    "graph_counts",
    """SELECT r_name, count(DISTINCT n_nationkey) AS files, count(DISTINCT c_custkey) AS classes, count(DISTINCT o_orderkey) AS methods
       FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
       JOIN orders ON o_custkey = c_custkey GROUP BY r_name""",
)
def graph_counts(t):
    """Inner traversal of a four-level hierarchy with distinct counts per level.

    Each level is counted on its own keys: classes and files that have methods are found by
    semi-joins, so no level is multiplied by the next.
    """
    per_customer = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("methods"))
    per_nation = (
        t.customer.join(per_customer, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy("c_nationkey")
        .agg(F.count(F.lit(1)).alias("classes"), F.sum("methods").alias("methods"))
    )
    per_region = (
        t.nation.join(per_nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .groupBy("n_regionkey")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("classes").alias("classes"), F.sum("methods").alias("methods"))
    )
    return t.region.join(per_region, F.col("r_regionkey") == F.col("n_regionkey")).select(
        "r_name", "files", "classes", "methods"
    )


@query(
    "outer_graph_counts",
    """SELECT n_name, count(DISTINCT s_suppkey) AS functions, count(DISTINCT c_custkey) AS classes
       FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 8000
       LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_name""",
)
def outer_graph_counts(t):
    functions = t.supplier.filter("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("n_nationkey"))
    classes = t.customer.filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey"))
    rows = t.nation.join(functions.agg(F.count(F.lit(1)).alias("functions")), "n_nationkey", "left")
    rows = rows.join(classes.agg(F.count(F.lit(1)).alias("classes")), "n_nationkey", "left")
    return rows.na.fill(0, ["functions", "classes"]).select("n_name", "functions", "classes")


@query(
    "repository_stats",
    f"""WITH c AS (SELECT DISTINCT repo, class_full_name FROM ({dv.CLASS_ROWS})),
    s AS (SELECT repo, string_agg(module_name, ',' ORDER BY module_name) AS sample_modules FROM (
        SELECT repo, module_name, row_number() OVER (PARTITION BY repo ORDER BY module_name) AS i FROM ({dv.FILES})) WHERE i <= 5 GROUP BY repo)
    SELECT r.repo, (SELECT count(*) FROM ({dv.FILES}) f WHERE f.repo = r.repo) AS files,
        (SELECT count(*) FROM c WHERE c.repo = r.repo) AS classes,
        (SELECT count(*) FROM c JOIN ({_METHODS}) m USING (class_full_name) WHERE c.repo = r.repo) AS methods,
        (SELECT count(*) FROM ({_FUNCTIONS}) f WHERE f.repo = r.repo) AS functions,
        (SELECT count(*) FROM c JOIN ({_ATTRIBUTES}) a USING (class_full_name) WHERE c.repo = r.repo) AS attributes, s.sample_modules
    FROM ({dv.REPOS}) r LEFT JOIN s ON s.repo = r.repo""",
)
def repository_stats(t):
    rows = cg.repository_stats(dv.graph(t))
    return rows.withColumn("sample_modules", F.array_join("sample_modules", ","))


@query(
    "explore_repository",
    f"""WITH c AS (SELECT DISTINCT repo, class_full_name FROM ({dv.CLASS_ROWS}) WHERE repo = 'asia')
    SELECT 'asia' AS repo, (SELECT count(*) FROM ({dv.FILES}) WHERE repo = 'asia') AS files, (SELECT count(*) FROM c) AS classes,
        (SELECT count(*) FROM ({_FUNCTIONS}) WHERE repo = 'asia') AS functions,
        (SELECT count(*) FROM c JOIN ({_METHODS}) m USING (class_full_name)) AS methods""",
)
def explore_repository(t):
    return cg.explore_repository(dv.graph(t), "asia")


@query("list_repositories", f"SELECT repo AS name FROM ({dv.REPOS})")
def list_repositories(t):
    return cg.list_repositories(dv.graph(t))


@query(
    "list_classes",
    f"""SELECT *, true AS limited FROM (SELECT DISTINCT class_name AS name, class_full_name AS full_name FROM ({dv.CLASS_ROWS})
        WHERE repo = 'asia' ORDER BY name, full_name LIMIT 20)""",
)
def list_classes(t):
    return cg.list_classes(dv.graph(t), "asia")


@query(
    "describe_class",
    f"""SELECT 'method' AS member_type, class_full_name, name, replace(params, '|', ';') AS parameters, return_type AS type
        FROM ({_METHODS}) WHERE class_name = 'C7'
        UNION ALL SELECT 'attribute', class_full_name, name, NULL, type FROM ({_ATTRIBUTES}) WHERE class_name = 'C7'""",
)
def describe_class(t):
    return cg.describe_class(dv.graph(t), "C7").withColumn("parameters", F.array_join("parameters", ";"))


@query(
    "find_methods",
    f"""SELECT class_name, class_full_name, name AS method_name, replace(params, '|', ';') AS parameters, return_type
        FROM ({_METHODS}) WHERE class_name = 'C7' AND name = 'do_5'""",
)
def find_methods(t):
    rows = cg.find_methods(dv.graph(t), "do_5", "C7").withColumn("parameters", F.array_join("parameters", ";"))
    return rows.drop("legacy_args", "limited")


@query(
    "find_methods_limited",
    f"""SELECT class_name, class_full_name, name AS method_name, true AS limited
        FROM ({_METHODS}) WHERE name = 'do_5' ORDER BY class_name, class_full_name LIMIT 20""",
)
def find_methods_limited(t):
    return cg.find_methods(dv.graph(t), "do_5").select("class_name", "class_full_name", "method_name", "limited")


_TARGETS = f"""SELECT DISTINCT i.import_name, f.repo, f.path, f.module_name FROM (SELECT DISTINCT import_name FROM ({dv.IMPORTS})) i
    JOIN ({dv.FILES}) f ON f.module_name = i.import_name OR starts_with(f.module_name, i.import_name)"""
_EDGES = f"""SELECT DISTINCT i.repo, i.path, t.repo AS target_repo, t.path AS target_path, t.module_name AS target_module
    FROM ({dv.IMPORTS}) i JOIN ({_TARGETS}) t USING (import_name)"""


@query("import_targets", _TARGETS)
def import_targets(t):
    return dv.graph(t).import_targets


@query("import_edges", _EDGES)
def import_edges(t):
    return cg.import_edges(dv.graph(t))


@query(
    "files_importing",
    f"SELECT DISTINCT repo, path, target_module AS imports FROM ({_EDGES}) WHERE contains(target_module, 'mod2')",
)
def files_importing(t):
    return cg.files_importing(dv.graph(t), "mod2")


@query(
    "classes_in_file",
    f"SELECT DISTINCT class_name AS name, class_full_name AS full_name FROM ({dv.CLASS_ROWS}) WHERE path = 'src/pkg2/mod7.py'",
)
def classes_in_file(t):
    return cg.classes_in_file(dv.graph(t), "src/pkg2/mod7.py")


@query(
    "methods_of_class",
    f"SELECT class_full_name, name FROM ({_METHODS}) WHERE contains(class_name, 'C1') OR contains(class_full_name, 'C1')",
)
def methods_of_class(t):
    return cg.methods_of_class(dv.graph(t), "C1").select("class_full_name", "name")


@query(
    "graph_sql",
    f"""SELECT repo, count(*) AS n, false AS limited FROM (SELECT DISTINCT repo, path, class_full_name FROM ({dv.CLASS_ROWS})) GROUP BY repo""",
)
def graph_sql(t):
    return cg.ad_hoc(dv.graph(t), "SELECT repo, count(*) AS n FROM class_files GROUP BY repo")


@query(
    "graph_sql_limited",
    f"""SELECT repo, path, true AS limited FROM (SELECT DISTINCT repo, path FROM ({dv.FILES})) ORDER BY path, repo LIMIT 20""",
)
def graph_sql_limited(t):
    """More rows than the cap: the first ones by all columns, and the flag."""
    rows = cg.ad_hoc(dv.graph(t), "SELECT path, repo FROM files")
    return rows.select("repo", "path", "limited")


# --- names -----------------------------------------------------------------------------------------

# File tree: one package per nation; parts live under source directories, some with package markers.
_PATHS = """SELECT concat('repo', p_partkey % 5) AS repo, CASE p_partkey % 4
      WHEN 0 THEN concat('src/app', p_size % 7, '/core/part', p_partkey, '.py')
      WHEN 1 THEN concat('lib/python/tool', p_size % 7, '/part', p_partkey, '.py')
      WHEN 2 THEN concat('app', p_size % 7, '/part', p_partkey, '.py')
      ELSE concat('part', p_partkey, '.py') END AS path FROM part
    UNION ALL SELECT DISTINCT concat('repo', p_partkey % 5), concat('src/app', p_size % 7, '/__init__.py') FROM part WHERE p_size % 7 < 4
    UNION ALL SELECT DISTINCT concat('repo', p_partkey % 5), concat('src/app', p_size % 7, '/core/__init__.py') FROM part WHERE p_size % 7 < 6"""


def _paths(t):
    return t.sql(_PATHS, "part")


@query(
    "module_names",
    f"""WITH p AS ({_PATHS}), d AS (SELECT DISTINCT repo, path[:-13] AS pkg FROM p WHERE path LIKE '%/__init__.py'),
    x AS (SELECT p.repo, p.path, string_split(p.path, '/') AS s FROM p),
    r AS (SELECT x.repo, x.path, min(len(string_split(d.pkg, '/'))) AS depth FROM x JOIN d ON d.repo = x.repo
          AND starts_with(x.path, d.pkg || '/') GROUP BY x.repo, x.path),
    k AS (SELECT x.*, coalesce(r.depth, list_min(list_filter(range(1, len(s) + 1), lambda i:
          lower(s[i]) NOT IN ('src', 'lib', 'source', 'python', 'pkg', 'packages'))), 1) AS start
          FROM x LEFT JOIN r ON r.repo = x.repo AND r.path = x.path)
    SELECT repo, path, replace(array_to_string(s[start:len(s)], '.'), '.py', '') AS module_name FROM k""",
)
def module_names(t):
    return cg.module_names(_paths(t))


@query(
    "project_modules",
    f"SELECT DISTINCT repo, split_part(replace(replace(path, '/', '.'), '.py', ''), '.', 1) AS project_module FROM ({_PATHS})",
)
def project_modules(t):
    return cg.project_modules(_paths(t))


_RAW_IMPORTS = """SELECT concat('repo', p_partkey % 5) AS repo, CASE p_partkey % 8 WHEN 0 THEN 'os.path' WHEN 1 THEN concat('app', p_size, '.x')
    WHEN 2 THEN 'numpy' WHEN 3 THEN concat('test_', p_brand) WHEN 4 THEN '_hidden.mod' WHEN 5 THEN 'ab' WHEN 6 THEN concat('srcery', p_size)
    ELSE concat('vendor.', p_brand) END AS import_name, p_partkey FROM part"""


@query(
    "internal_imports",
    f"""WITH i AS ({_RAW_IMPORTS}), m AS (SELECT DISTINCT repo, split_part(replace(replace(path, '/', '.'), '.py', ''), '.', 1) AS pm FROM ({_PATHS}))
    SELECT i.repo, i.import_name, i.p_partkey FROM i WHERE split_part(import_name, '.', 1) NOT IN ({', '.join(f"'{m}'" for m in cg.EXTERNAL_MODULES)})
      AND (EXISTS (SELECT 1 FROM m WHERE m.repo = i.repo AND starts_with(i.import_name, m.pm))
           OR (NOT regexp_matches(lower(split_part(import_name, '.', 1)), 'test|mock|fake')
               AND NOT starts_with(import_name, '_') AND length(split_part(import_name, '.', 1)) > 2))""",
)
def internal_imports(t):
    modules = cg.project_modules(_paths(t))
    return cg.internal_imports(t.sql(_RAW_IMPORTS, "part"), modules)


@query(
    "wanted_files",
    """SELECT p_partkey, path FROM (SELECT p_partkey, p_size, CASE p_partkey % 6 WHEN 0 THEN concat('src/part', p_partkey, '.py')
          WHEN 1 THEN concat('tests/part', p_partkey, '.py') WHEN 2 THEN concat('a/.cache/part', p_partkey, '.py')
          WHEN 3 THEN concat('a/test_part', p_partkey, '.py') WHEN 4 THEN 'a/setup.py' ELSE concat('a/part', p_partkey, '.txt') END AS path FROM part)
       WHERE path LIKE 'src/%' AND p_size * 12000 < 500000""",
)
def wanted_files(t):
    key = F.col("p_partkey")
    path = (
        F.when(key % 6 == 0, F.concat(F.lit("src/part"), key, F.lit(".py")))
        .when(key % 6 == 1, F.concat(F.lit("tests/part"), key, F.lit(".py")))
        .when(key % 6 == 2, F.concat(F.lit("a/.cache/part"), key, F.lit(".py")))
        .when(key % 6 == 3, F.concat(F.lit("a/test_part"), key, F.lit(".py")))
        .when(key % 6 == 4, "a/setup.py")
        .otherwise(F.concat(F.lit("a/part"), key, F.lit(".txt")))
    )
    rows = t.part.select("p_partkey", path.alias("path"), (F.col("p_size") * 12000).alias("size"))
    return repo_files.wanted_files(rows).select("p_partkey", "path")


@query(
    "parameter_rendering",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN '[keyword_only] ' ELSE '' END || 'p' || p_size || ':' || p_type ||
           CASE WHEN p_partkey % 2 = 1 THEN '=' || p_brand WHEN p_partkey % 4 = 0 THEN '=None' ELSE '' END AS detailed,
           'p' || p_size || ':' || p_type AS simple FROM part""",
)
def parameter_rendering(t):
    key = F.col("p_partkey")
    params = F.array(
        F.struct(
            F.concat(F.lit("p"), "p_size").alias("name"),
            F.col("p_type").alias("type"),
            F.when(key % 3 == 2, "keyword_only").otherwise("positional").alias("kind"),
            ((key % 2 == 1) | (key % 4 == 0)).alias("optional"),
            F.when(key % 2 == 1, F.col("p_brand")).alias("default"),
        )
    )
    return t.part.select(
        "p_partkey",
        F.get(pm.render_detailed(params), F.lit(0)).alias("detailed"),
        F.get(pm.render_simple(params), F.lit(0)).alias("simple"),
    )


@query(
    "replace_repositories",
    f"""SELECT repo, path, module_name, CAST(line_count AS INTEGER) AS line_count FROM ({dv.FILES}) WHERE repo NOT IN ('asia', 'europe')
        UNION ALL SELECT repo, 'new/' || path, module_name, CAST(line_count AS INTEGER) FROM ({dv.FILES}) WHERE repo = 'asia'""",
)
def replace_repositories(t):
    """Two repositories are cleared; the rebuild brings files for one of them only."""
    files = dv.graph(t).files
    rebuilt = files.filter("repo = 'asia'").withColumn("path", F.concat(F.lit("new/"), "path"))
    cleared = files.select("repo").filter("repo IN ('asia', 'europe')")
    return tables.replace_repository(files, rebuilt, cleared)


# --- from source text --------------------------------------------------------------------------------


def source_files(t):
    """One Python file per customer, written from its columns; some do not parse."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    text = F.concat(
        F.lit("import os\nfrom shop.base import Thing\n\nclass Customer"),
        key,
        F.lit(":\n    balance: float = 1.0\n    _secret: int = 0\n    def pay(self, amount: int, unit='"),
        F.col("c_mktsegment"),
        F.lit("', *rest, flag, **options) -> bool:\n        return True\n    def _hidden(self):\n        pass\n"),
        F.lit("\nclass Shared:\n    def rank(self, level=None) -> List[int]:\n        return "),
        key,
        F.lit("\n\ndef total_"),
        nation,
        F.lit("(x, y: Dict[str, int] = {}):\n    def inner(z):\n        return z\n    return inner(x)\n"),
    )
    broken = F.when(key % 50 == 7, F.concat(text, F.lit("def (:\n"))).otherwise(text)
    return t.customer.select(
        F.concat(F.lit("shop"), key % 3).alias("repo"),
        F.concat(F.lit("src/nation"), nation, F.lit("/customer"), key, F.lit(".py")).alias("path"),
        broken.alias("content"),
    )


_SOURCES = """SELECT c_custkey, concat('shop', c_custkey % 3) AS repo, concat('src/nation', c_nationkey, '/customer', c_custkey, '.py') AS path,
    concat('nation', c_nationkey, '.customer', c_custkey) AS module, c_mktsegment, c_nationkey FROM customer"""


@query(
    "file_facts",
    f"""SELECT repo, path, CASE WHEN c_custkey % 50 = 7 THEN NULL ELSE 19 END AS line_count,
            CASE WHEN c_custkey % 50 = 7 THEN 0 ELSE 2 END AS classes, CASE WHEN c_custkey % 50 = 7 THEN 0 ELSE 2 END AS functions,
            CASE WHEN c_custkey % 50 = 7 THEN '' ELSE 'os,shop.base' END AS imports, c_custkey % 50 = 7 AS failed FROM ({_SOURCES})""",
)
def file_facts(t):
    facts = code_facts.extract_definitions(source_files(t))
    return facts.select(
        "repo",
        "path",
        "line_count",
        F.size("classes").alias("classes"),
        F.size("functions").alias("functions"),
        F.array_join("imports", ",").alias("imports"),
        F.col("error").isNotNull().alias("failed"),
    )


@query(
    "source_methods",
    f"""SELECT concat(module, '.Customer', c_custkey, '::pay') AS id, concat('Customer', c_custkey) AS class_name, 'bool' AS return_type,
            concat('amount:int;unit:Any=''', c_mktsegment, ''';[var_positional] *rest:Any=None;[keyword_only] flag:Any;[var_keyword] **options:Dict[str, Any]=None') AS params,
            'amount,unit' AS args FROM ({_SOURCES}) WHERE c_custkey % 50 <> 7
        UNION ALL SELECT concat(module, '.Shared::rank'), 'Shared', 'List[int]', 'level:Any=None', 'level' FROM ({_SOURCES}) WHERE c_custkey % 50 <> 7""",
)
def source_methods(t):
    graph = cg.build_graph(cut_lineage(code_facts.extract_definitions(source_files(t))))
    return graph.methods.select(
        "id",
        "class_name",
        "return_type",
        F.array_join("params_detailed", ";").alias("params"),
        F.array_join("args", ",").alias("args"),
    )


@query(
    "source_functions",
    f"""SELECT repo, path, concat('total_', c_nationkey) AS name, concat(module, '.total_', c_nationkey) AS full_name, 'x:Any;y:Dict[str, int]={{}}' AS params
        FROM ({_SOURCES}) WHERE c_custkey % 50 <> 7
        UNION ALL SELECT repo, path, 'inner', concat(module, '.inner'), 'z:Any' FROM ({_SOURCES}) WHERE c_custkey % 50 <> 7""",
)
def source_functions(t):
    graph = cg.build_graph(cut_lineage(code_facts.extract_definitions(source_files(t))))
    return graph.functions.select("repo", "path", "name", "full_name", F.array_join("params_detailed", ";").alias("params"))


@query(
    "load_totals",
    f"""SELECT repo, count(*) AS files, CAST(count(*) * 2 AS BIGINT) AS classes, CAST(count(*) * 2 AS BIGINT) AS methods,
            CAST(count(*) * 2 AS BIGINT) AS functions, count(*) AS imports FROM ({_SOURCES}) WHERE c_custkey % 50 <> 7 GROUP BY repo""",
)
def load_totals(t):
    facts = cut_lineage(code_facts.extract_definitions(source_files(t)))
    return cg.load_totals(facts, cg.build_graph(facts).imports)
