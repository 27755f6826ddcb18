"""Code graph as tables: one per node label, one per edge type."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartula.functions import params as pm
from chartula.operators.joins import salted_join
from chartula.operators.ranking import first_per_key, top_per_group
from chartula.session import cut_lineage
from chartula.sources import tables

# Modules that never belong to the analysed project.
EXTERNAL_MODULES = [
    "os", "sys", "json", "logging", "datetime", "pathlib", "typing", "collections", "asyncio", "subprocess", "ast",
    "re", "string", "urllib", "http", "email", "time", "uuid", "hashlib", "base64", "itertools", "functools",
    "operator", "contextlib", "copy", "pickle", "tempfile", "shutil", "glob", "fnmatch", "io", "codecs", "locale",
    "platform", "socket", "ssl", "threading", "queue", "multiprocessing", "concurrent", "warnings", "traceback",
    "inspect", "importlib", "pkgutil", "types", "weakref", "gc", "dataclasses", "enum", "abc", "numbers", "decimal",
    "fractions", "math", "cmath", "random", "statistics", "requests", "urllib3", "httpx", "aiohttp", "flask",
    "django", "fastapi", "pydantic", "sqlalchemy", "alembic", "psycopg2", "pymongo", "redis", "celery", "pytest",
    "unittest", "mock", "faker", "factory", "hypothesis", "numpy", "pandas", "matplotlib", "seaborn", "scipy",
    "sklearn", "torch", "tensorflow", "keras", "opencv", "pillow", "boto3", "botocore", "azure", "google", "openai",
    "anthropic", "langchain", "transformers", "huggingface_hub", "click", "typer", "rich", "colorama", "tqdm",
    "python-dotenv", "pyyaml", "toml", "configargparse", "marshmallow", "attrs", "dataclasses-json", "jsonschema",
    "cerberus", "voluptuous", "schema", "jinja2", "mako", "cryptography", "bcrypt", "passlib", "jwt", "authlib",
    "oauthlib",
]
# Leading directories that are not part of a module name.
SOURCE_DIRS = ["src", "lib", "source", "python", "pkg", "packages"]

LIST_LIMIT = 20


@dataclass
class CodeGraph:
    """files(repo, path, module_name, line_count), classes(full_name, name),
    class_files(repo, path, full_name), methods and attributes keyed by owner and name,
    functions keyed by (repo, path, name), imports(repo, path, import_name),
    import_targets(import_name, repo, path, module_name)."""

    repositories: DataFrame
    files: DataFrame
    classes: DataFrame
    class_files: DataFrame
    methods: DataFrame
    attributes: DataFrame
    functions: DataFrame
    imports: DataFrame
    import_targets: DataFrame

    def materialised(self, *names: str) -> CodeGraph:
        """The same graph with its tables (or the named ones) kept in the checkpoint folder."""
        kept = names or [f.name for f in fields(self)]
        return replace(self, **{name: cut_lineage(getattr(self, name)) for name in kept})

    def register(self, prefix: str = "") -> None:
        """Temp views over every table, for ad-hoc SQL."""
        for f in fields(self):
            getattr(self, f.name).createOrReplaceTempView(prefix + f.name)


# --- names --------------------------------------------------------------------------------------


def without_suffix(path: Column) -> Column:
    return F.replace(path, F.lit(".py"), F.lit(""))


def module_names(files: DataFrame) -> DataFrame:
    """Adds the importable ``module_name``.

    The outermost directory holding an ``__init__.py`` starts the name; without one, leading
    source directories are dropped.
    """
    parts = F.split("path", "/")
    with_dir = files.withColumn("_parts", parts).withColumn(
        "_dir", F.array_join(F.slice("_parts", 1, F.size("_parts") - 1), "/")
    )
    packages = (
        with_dir.filter((F.element_at("_parts", -1) == "__init__.py") & (F.col("_dir") != ""))
        .select("repo", F.col("_dir").alias("_package"))
        .distinct()
    )
    # Directories are far fewer than files: their package roots are found once per directory.
    levels = (
        with_dir.select("repo", "_dir")
        .filter(F.col("_dir") != "")
        .distinct()
        .withColumn("_names", F.split("_dir", "/"))
        .select("repo", "_dir", "_names", F.explode(F.sequence(F.lit(1), F.size("_names"))).alias("_depth"))
        .withColumn("_package", F.array_join(F.slice("_names", 1, F.col("_depth")), "/"))
    )
    roots = (
        levels.join(packages, ["repo", "_package"], "left_semi")
        .groupBy("repo", "_dir")
        .agg(F.min("_depth").alias("_root"))
    )
    joined = with_dir.join(roots, ["repo", "_dir"], "left")
    # Leading source directories: everything before the first part that is not one.
    kept = F.filter(
        F.transform("_parts", lambda p, i: F.when(~F.lower(p).isin(SOURCE_DIRS), i + 1)),
        lambda i: i.isNotNull(),
    )
    start = F.coalesce("_root", F.get(kept, F.lit(0)), F.lit(1))
    name = F.array_join(F.slice("_parts", start, F.size("_parts")), ".")
    return joined.select(*files.columns, without_suffix(name).alias("module_name"))


def project_modules(files: DataFrame) -> DataFrame:
    """``(repo, project_module)``: first path segments of the files of a repository."""
    first = F.substring_index(without_suffix(F.replace("path", F.lit("/"), F.lit("."))), ".", 1)
    return files.select("repo", first.alias("project_module")).filter("project_module <> ''").distinct()


def internal_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports ``(repo, import_name, ...)`` that are likely internal to their repository.

    The prefix test against project modules is an equi-join on the exploded prefixes of the
    distinct import names.
    """
    names = imports.select("repo", "import_name").distinct().filter("import_name <> ''")
    prefixes = names.select("*", F.explode(prefixes_of(F.col("import_name"))).alias("project_module"))
    known = prefixes.join(modules, ["repo", "project_module"], "left_semi").select("repo", "import_name").distinct()
    names = names.join(known.withColumn("_known", F.lit(True)), ["repo", "import_name"], "left")
    base = F.substring_index("import_name", ".", 1)
    odd = F.lower(base).rlike("test|mock|fake") | base.startswith("_") | (F.length(base) <= 2)
    internal = F.col("import_name").startswith(".") | (
        ~base.isin(EXTERNAL_MODULES) & (F.coalesce("_known", F.lit(False)) | ~odd)
    )
    wanted = names.filter(internal).select("repo", "import_name")
    return imports.join(wanted, ["repo", "import_name"], "left_semi")


def prefixes_of(name: Column) -> Column:
    """All non-empty prefixes, the whole included."""
    return F.transform(F.sequence(F.lit(1), F.length(name)), lambda n: F.left(name, n))


def dotted_prefixes(name: Column) -> Column:
    parts = F.split(name, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ".")
    )


# --- build ---------------------------------------------------------------------------------------


def build_graph(facts: DataFrame) -> CodeGraph:
    """Node and edge tables from file facts; of duplicate definitions the first wins."""
    # Package roots come from all files: an __init__.py names its package whether it parses or not.
    good = facts.filter(F.col("error").isNull())
    named = module_names(facts).filter(F.col("error").isNull())
    files = named.select("repo", "path", "module_name", "line_count")
    class_rows = named.select("repo", "path", "module_name", F.explode("classes").alias("_c")).select(
        "repo",
        "path",
        F.col("_c.ord").alias("_class_ord"),
        F.col("_c.name").alias("class_name"),
        F.concat_ws(".", "module_name", "_c.name").alias("class_full_name"),
        F.col("_c.methods").alias("_methods"),
        F.col("_c.attributes").alias("_attributes"),
    )
    owner = ["repo", "path", "_class_ord", "class_name", "class_full_name"]
    method_rows = class_rows.select(*owner, F.explode("_methods").alias("_m")).select(
        *owner, F.col("_m.ord").alias("_ord"), *_callable_columns("_m")
    )
    attribute_rows = class_rows.select(*owner, F.explode("_attributes").alias("_a")).select(
        *owner, F.col("_a.ord").alias("_ord"), F.col("_a.name").alias("name"), F.col("_a.type").alias("type")
    )
    first = ["repo", "path", "_class_ord", "_ord"]

    def members(rows: DataFrame) -> DataFrame:
        unique = first_per_key(rows, ["class_full_name", "name"], first)
        return unique.drop("repo", "path", "_class_ord", "_ord").select(
            F.concat_ws("::", "class_full_name", "name").alias("id"),
            F.concat_ws(".", "class_full_name", "name").alias("full_name"),
            "*",
        )

    function_rows = named.select("repo", "path", "module_name", F.explode("functions").alias("_f")).select(
        "repo",
        "path",
        F.col("_f.ord").alias("_ord"),
        *_callable_columns("_f"),
        F.concat_ws(".", "module_name", "_f.name").alias("full_name"),
    )
    functions = first_per_key(function_rows, ["repo", "path", "name"], ["_ord"]).drop("_ord")
    raw_imports = good.select("repo", "path", F.explode("imports").alias("import_name"))
    imports = internal_imports(raw_imports, project_modules(good)).select("repo", "path", "import_name").distinct()
    return CodeGraph(
        repositories=facts.select("repo").distinct(),
        files=files,
        classes=class_rows.select(
            F.col("class_full_name").alias("full_name"), F.col("class_name").alias("name")
        ).distinct(),
        class_files=class_rows.select("repo", "path", F.col("class_full_name").alias("full_name")).distinct(),
        methods=members(method_rows),
        attributes=members(attribute_rows),
        functions=functions,
        imports=imports,
        import_targets=import_targets(imports, files),
    )


def _callable_columns(column: str) -> list[Column]:
    params = F.col(f"{column}.params")
    return [
        F.col(f"{column}.name").alias("name"),
        F.col(f"{column}.args").alias("args"),
        pm.render_simple(params).alias("params_list"),
        pm.render_detailed(params).alias("params_detailed"),
        F.col(f"{column}.return_type").alias("return_type"),
    ]


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Files an import name stands for: equal module name, or module name starting with it.

    An equi-join on the exploded prefixes of the distinct module names.
    """
    names = imports.select("import_name").distinct()
    modules = files.select("module_name").distinct()
    prefixes = modules.select("module_name", F.explode(prefixes_of(F.col("module_name"))).alias("import_name"))
    matched = prefixes.join(names, "import_name", "left_semi")
    # Many files may share a module name (``__init__``, ``utils``).
    found = salted_join(files.select("repo", "path", "module_name"), matched, ["module_name"], salt_on=["repo", "path"])
    return found.select("import_name", "repo", "path", "module_name")


def import_edges(graph: CodeGraph) -> DataFrame:
    """File-to-file import edges."""
    targets = graph.import_targets.select(
        "import_name",
        F.col("repo").alias("target_repo"),
        F.col("path").alias("target_path"),
        F.col("module_name").alias("target_module"),
    )
    edges = salted_join(graph.imports, targets, ["import_name"], salt_on=["repo", "path"])
    return edges.drop("import_name").distinct()


def replace_repositories(stored: CodeGraph, rebuilt: CodeGraph, repos: DataFrame) -> CodeGraph:
    """Clear ``repos`` and add their rebuilt graph.

    Classes and members belong to the repositories that still define them.
    """

    def swap(name: str) -> DataFrame:
        return tables.replace_repository(getattr(stored, name), getattr(rebuilt, name), repos)

    files, class_files, imports = swap("files"), swap("class_files"), swap("imports")
    live = class_files.select("full_name").distinct()

    def merged(name: str, key: str, ids: list[str]) -> DataFrame:
        old, new = getattr(stored, name), getattr(rebuilt, name)
        kept = old.join(live.withColumnRenamed("full_name", key), key, "left_semi").select(*old.columns)
        fresh = new.select(*old.columns).join(kept.select(*ids), ids, "left_anti").select(*old.columns)
        return kept.unionByName(fresh)

    return replace(
        rebuilt,
        repositories=stored.repositories.join(repos, "repo", "left_anti").unionByName(rebuilt.repositories).distinct(),
        files=files,
        class_files=class_files,
        classes=merged("classes", "full_name", ["full_name"]),
        methods=merged("methods", "class_full_name", ["id"]),
        attributes=merged("attributes", "class_full_name", ["id"]),
        functions=swap("functions"),
        imports=imports,
        import_targets=import_targets(imports, files),
    )


# --- counts ----------------------------------------------------------------------------------------


def repository_stats(graph: CodeGraph, *, samples: int = 5) -> DataFrame:
    """Per repository: files, classes, methods, functions, attributes and sample modules.

    Each branch is aggregated on its own before it is joined, and repositories without
    children stay.
    """
    owned = graph.class_files.select("repo", F.col("full_name").alias("class_full_name")).distinct()

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("repo").agg(F.count(F.lit(1)).alias(name))

    def member_count(members: DataFrame, name: str) -> DataFrame:
        per_class = members.groupBy("class_full_name").agg(F.count(F.lit(1)).alias("_n"))
        return owned.join(per_class, "class_full_name").groupBy("repo").agg(F.sum("_n").alias(name))

    distinct_modules = graph.files.select("repo", "module_name").distinct()
    sampled = top_per_group(
        distinct_modules, ["repo"], [F.asc("module_name")], samples, salt_on=["module_name"]
    )
    sampled = sampled.groupBy("repo").agg(
        F.array_sort(F.collect_list("module_name")).alias("sample_modules")
    )
    stats = graph.repositories
    for branch in (
        counted(graph.files, "files"),
        counted(owned, "classes"),
        member_count(graph.methods, "methods"),
        counted(graph.functions, "functions"),
        member_count(graph.attributes, "attributes"),
    ):
        stats = stats.join(branch, "repo", "left")
    stats = stats.join(sampled, "repo", "left")
    counts = ["files", "classes", "methods", "functions", "attributes"]
    empty = F.array().cast("array<string>")
    return stats.select(
        "repo",
        *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("sample_modules", empty).alias("sample_modules"),
    )


def load_totals(facts: DataFrame, imports: DataFrame) -> DataFrame:
    """Per repository: files analysed, and definitions as written, duplicates included."""
    good = facts.filter(F.col("error").isNull())
    methods = F.aggregate("classes", F.lit(0), lambda n, c: n + F.size(c["methods"]))
    totals = good.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.size("classes")).alias("classes"),
        F.sum(methods).alias("methods"),
        F.sum(F.size("functions")).alias("functions"),
    )
    counted = imports.groupBy("repo").agg(F.count(F.lit(1)).alias("imports"))
    return totals.join(counted, "repo", "left").withColumn("imports", F.coalesce("imports", F.lit(0)))


# --- searches and commands ---------------------------------------------------------------------------


def files_importing(graph: CodeGraph, target: str) -> DataFrame:
    """Files whose import leads to a module with ``target`` in its name."""
    edges = import_edges(replace(graph, import_targets=graph.import_targets.filter(F.col("module_name").contains(target))))
    return edges.select("repo", "path", F.col("target_module").alias("imports"))


def classes_in_file(graph: CodeGraph, path: str, repo: str | None = None) -> DataFrame:
    rows = graph.class_files.filter(F.col("path") == path)
    if repo is not None:
        rows = rows.filter(F.col("repo") == repo)
    return rows.select("full_name").distinct().join(graph.classes, "full_name").select("name", "full_name")


def methods_of_class(graph: CodeGraph, class_name: str) -> DataFrame:
    owner = F.col("class_name").contains(class_name) | F.col("class_full_name").contains(class_name)
    return graph.methods.filter(owner).select("class_full_name", "name", "args")


def list_repositories(graph: CodeGraph) -> DataFrame:
    return graph.repositories.select(F.col("repo").alias("name")).orderBy("name")


def explore_repository(graph: CodeGraph, repo: str) -> DataFrame:
    def only(df: DataFrame) -> DataFrame:
        return df.filter(F.col("repo") == repo)

    narrowed = replace(
        graph,
        repositories=only(graph.repositories),
        files=only(graph.files),
        class_files=only(graph.class_files),
        functions=only(graph.functions),
    )
    return repository_stats(narrowed).select("repo", "files", "classes", "functions", "methods")


def _limited(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """First ``limit`` rows with a flag telling whether there were more."""
    # The windows see at most limit + 1 rows.
    more = df.orderBy(*order).limit(limit + 1).withColumn("_all", F.lit(0))
    everything = Window.partitionBy("_all")
    more = more.withColumn("limited", F.count(F.lit(1)).over(everything) > limit)
    more = more.withColumn("_rank", F.row_number().over(everything.orderBy(*order)))
    return more.filter(F.col("_rank") <= limit).drop("_all", "_rank").orderBy(*order)


def list_classes(graph: CodeGraph, repo: str | None = None, limit: int = LIST_LIMIT) -> DataFrame:
    rows = graph.classes
    if repo is not None:
        inside = graph.class_files.filter(F.col("repo") == repo).select("full_name").distinct()
        rows = rows.join(inside, "full_name", "left_semi")
    return _limited(rows.select("name", "full_name"), ["name", "full_name"], limit)


def _owned_by(members: DataFrame, class_name: str) -> DataFrame:
    return members.filter((F.col("class_name") == class_name) | (F.col("class_full_name") == class_name))


def _parameters() -> Column:
    return F.when(F.size("params_detailed") > 0, F.col("params_detailed")).otherwise(
        F.coalesce("params_list", F.array().cast("array<string>"))
    )


def describe_class(graph: CodeGraph, class_name: str) -> DataFrame:
    """Methods and attributes of a class given by simple or full name."""
    methods = _owned_by(graph.methods, class_name).select(
        F.lit("method").alias("member_type"),
        "class_full_name",
        "name",
        _parameters().alias("parameters"),
        F.coalesce("return_type", F.lit("Any")).alias("type"),
    )
    attributes = _owned_by(graph.attributes, class_name).select(
        F.lit("attribute").alias("member_type"),
        "class_full_name",
        "name",
        F.lit(None).cast("array<string>").alias("parameters"),
        F.coalesce("type", F.lit("Any")).alias("type"),
    )
    return methods.unionByName(attributes).orderBy(F.desc("member_type"), "name", "class_full_name")


def find_methods(graph: CodeGraph, method_name: str, class_name: str | None = None, limit: int = LIST_LIMIT) -> DataFrame:
    rows = graph.methods if class_name is None else _owned_by(graph.methods, class_name)
    rows = rows.filter(F.col("name") == method_name).select(
        "class_name",
        "class_full_name",
        F.col("name").alias("method_name"),
        _parameters().alias("parameters"),
        F.coalesce("return_type", F.lit("Any")).alias("return_type"),
        F.coalesce("args", F.array().cast("array<string>")).alias("legacy_args"),
    )
    if class_name is None:
        return _limited(rows, ["class_name", "class_full_name"], limit)
    return rows.withColumn("limited", F.lit(False))


def ad_hoc(graph: CodeGraph, sql: str, limit: int | None = LIST_LIMIT) -> DataFrame:
    """Spark SQL over the graph's views: at most ``limit`` rows (None: all), and ``limited`` if there were more."""
    graph.register()
    rows = graph.files.sparkSession.sql(sql)
    return rows.withColumn("limited", F.lit(False)) if limit is None else _limited(rows, rows.columns, limit)
