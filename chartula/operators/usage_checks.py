"""Validation of script usage against the code graph, for all scripts in one set of joins.

Lookups run on distinct keys and are fanned back to the usages.  Every "first match" is the
smallest by full name, so results do not depend on row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartula.functions import params as pm
from chartula.operators.code_graph import CodeGraph, dotted_prefixes
from chartula.operators.joins import salted_join
from chartula.operators.keywords import contained
from chartula.operators.ranking import first_per_key, top_per_group
from chartula.operators.usage_facts import Usage
from chartula.session import cut_lineage

SUGGESTIONS = 5
SUGGESTION_PREFIX = 3
CONFIDENT = 0.7


def _no_strings() -> Column:
    return F.array().cast("array<string>")


# --- repositories for modules -----------------------------------------------------------------------


def module_matches(modules: DataFrame, files: DataFrame) -> DataFrame:
    """``(module, repo, file_count)``: repositories with files in the module.

    Module names are exploded into dotted prefixes, which turns equality, "starts with module
    and a dot" and "first segment equals" into one equi-join.
    """
    prefixes = files.select("repo", F.explode(F.array_distinct(dotted_prefixes(F.col("module_name")))).alias("module"))
    counts = prefixes.groupBy("module", "repo").agg(F.count(F.lit(1)).alias("file_count"))
    return counts.join(modules.select("module").distinct(), "module", "left_semi").select(
        "module", "repo", "file_count"
    )


def _folded(repo: Column) -> Column:
    low = F.lower(repo)
    return F.array(
        F.struct(F.lit(1).alias("priority"), low.alias("folded")),
        F.struct(F.lit(2).alias("priority"), F.replace(low, F.lit("-"), F.lit("_")).alias("folded")),
        F.struct(F.lit(3).alias("priority"), F.replace(low, F.lit("_"), F.lit("-")).alias("folded")),
    )


def name_matches(modules: DataFrame, repositories: DataFrame) -> DataFrame:
    """``(module, repo, priority)``: repositories named like the module, up to case, ``-`` and ``_``."""
    names = repositories.select("repo", F.explode(_folded(F.col("repo"))).alias("_f")).select("repo", "_f.*")
    wanted = modules.select("module", F.lower("module").alias("folded")).distinct()
    return wanted.join(names, "folded").groupBy("module", "repo").agg(F.min("priority").alias("priority"))


def ranked_repositories(modules: DataFrame, graph: CodeGraph, limit: int = 5) -> DataFrame:
    """Up to ``limit`` module-based and name-based repositories per module, best first; module-based
    ones lead and each repository appears once."""
    by_module = top_per_group(
        module_matches(modules, graph.files), ["module"], [F.desc("file_count"), F.asc("repo")], limit, salt_on=["repo"]
    )
    by_name = top_per_group(
        name_matches(modules, graph.repositories), ["module"], [F.asc("priority"), F.asc("repo")], limit
    )
    both = by_module.select("module", "repo", F.lit(0).alias("_kind"), "rank").unionByName(
        by_name.select("module", "repo", F.lit(1).alias("_kind"), "rank")
    )
    once = both.groupBy("module", "repo").agg(F.min(F.struct("_kind", "rank")).alias("_place"))
    return top_per_group(once, ["module"], [F.asc("_place"), F.asc("repo")], 2 * limit).drop("_place")


def _best_by_prefix(files: DataFrame) -> DataFrame:
    """``(module, repo)`` for every dotted prefix of a module name: the repository with most files."""
    prefixes = files.select("repo", F.explode(F.array_distinct(dotted_prefixes(F.col("module_name")))).alias("module"))
    counts = prefixes.groupBy("module", "repo").agg(F.count(F.lit(1)).alias("_n"))
    return first_per_key(counts.withColumn("_o", -F.col("_n")), ["module"], ["_o", "repo"]).select("module", "repo")


def best_repository(modules: DataFrame, graph: CodeGraph) -> DataFrame:
    """``(module, repo)``: the repository with most files in the module, else the best by name."""
    names = graph.repositories.select("repo", F.explode(_folded(F.col("repo"))).alias("_f")).select("repo", "_f.*")
    by_name = first_per_key(names, ["folded"], ["priority", "repo"]).select("folded", F.col("repo").alias("_named"))
    asked = modules.select("module").distinct().withColumn("folded", F.lower("module"))
    joined = asked.join(_best_by_prefix(graph.files), "module", "left").join(by_name, "folded", "left")
    return joined.select("module", F.coalesce("repo", "_named").alias("repo")).filter("repo IS NOT NULL")


def owner_repository(modules: DataFrame, graph: CodeGraph) -> DataFrame:
    """``best_repository`` with the wider name fallback: one name may contain the other."""
    asked = modules.select("module").distinct().filter("module <> ''").join(_best_by_prefix(graph.files), "module", "left")
    rest = asked.filter("repo IS NULL").select("module", F.lower("module").alias("_low"))
    # Repositories whose names only differ in case are one name; its first repository stands for it.
    names = graph.repositories.groupBy(F.lower("repo").alias("_name")).agg(F.min("repo").alias("repo"))
    under, dash = F.replace("_name", F.lit("-"), F.lit("_")), F.replace("_name", F.lit("_"), F.lit("-"))
    names = names.select("*", under.alias("_under"), dash.alias("_dash"))
    wanted = rest.select("_low").distinct()
    inside_name = contained(wanted.withColumnRenamed("_low", "part"), names.select(F.col("_name").alias("whole")).distinct())
    inside_module = contained(names.select(F.col("_under").alias("part")).distinct(), wanted.withColumnRenamed("_low", "whole"))
    pairs = (
        inside_name.join(names, F.col("whole") == F.col("_name")).select(F.col("part").alias("_low"), "_name", "_under", "repo")
        .union(inside_module.join(names, F.col("part") == F.col("_under")).select(F.col("whole").alias("_low"), "_name", "_under", "repo"))
        .union(wanted.join(names, F.col("_low") == F.col("_dash")).select("_low", "_name", "_under", "repo"))
    )
    priority = F.when(F.col("_name") == F.col("_low"), 1).when(F.col("_under") == F.col("_low"), 2).otherwise(3)
    best = first_per_key(pairs.withColumn("priority", priority), ["_low"], ["priority", "repo"]).select("_low", "repo")
    by_name = rest.join(best, "_low").select("module", "repo")
    return asked.filter("repo IS NOT NULL").select("module", "repo").unionByName(by_name)


def similar_modules(modules: DataFrame, repositories: DataFrame, limit: int = SUGGESTIONS) -> DataFrame:
    """``(module, suggestions)``: repositories whose folded name contains the first three characters.

    Suggestions are listed once for each such start; modules then look theirs up.
    """
    grams = repositories.select(
        "repo", F.explode(F.array_distinct(F.flatten(F.transform(_folded(F.col("repo")), lambda f: _grams(f["folded"]))))).alias("_gram")
    )
    wanted = modules.select("module", F.lower(F.left("module", F.lit(SUGGESTION_PREFIX))).alias("_gram")).distinct()
    listed = _suggest(grams.join(wanted.select("_gram").distinct(), "_gram", "left_semi"), ["_gram"], "repo", limit)
    return salted_join(wanted, listed, ["_gram"], salt_on=["module"]).select("module", "suggestions")


def _grams(text: Column) -> Column:
    """Distinct substrings of one to three characters."""
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    every = F.transform(starts, lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.substring(text, i, k)))
    return F.array_distinct(F.flatten(every))


def _suggest(rows: DataFrame, keys: list[str], name: str, limit: int) -> DataFrame:
    best = top_per_group(rows.select(*keys, name).distinct(), keys, [F.asc(name)], limit, salt_on=[name])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", name))), lambda s: s[name])
    return best.groupBy(*keys).agg(listed.alias("suggestions"))


# --- lookups ------------------------------------------------------------------------------------------

#: What a definition is asked under.
HELD = ["kind", "owner", "name"]


def _definitions(graph: CodeGraph) -> DataFrame:
    """All classes, members and functions in one shape: kind, simple and full owner, name, payload, order."""
    no_type, no_repo = F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("repo")
    classes = graph.classes.select(F.lit("class").alias("kind"), F.col("name").alias("simple"), F.col("full_name").alias("full"), F.lit("").alias("name"), F.lit(None).cast("array<string>").alias("expected"), no_type, F.col("full_name").alias("place"), no_repo)
    methods = graph.methods.select(F.lit("method").alias("kind"), F.col("class_name").alias("simple"), F.col("class_full_name").alias("full"), "name", _expected().alias("expected"), F.col("return_type").alias("type"), F.col("id").alias("place"), no_repo)
    attributes = graph.attributes.select(F.lit("attribute").alias("kind"), F.col("class_name").alias("simple"), F.col("class_full_name").alias("full"), "name", F.lit(None).cast("array<string>").alias("expected"), "type", F.col("id").alias("place"), no_repo)
    functions = graph.functions.select(F.lit("function").alias("kind"), F.col("name").alias("simple"), F.col("full_name").alias("full"), F.lit("").alias("name"), _expected().alias("expected"), no_type, F.concat_ws("|", "full_name", "repo", "path").alias("place"), "repo")
    return classes.unionByName(methods).unionByName(attributes).unionByName(functions)


def _class_homes(graph: CodeGraph) -> DataFrame:
    return graph.class_files.select("repo", "full_name").distinct()


def _module_of(owner: str) -> tuple[Column, Column]:
    """Module part and simple name of a dotted name."""
    simple = F.substring_index(owner, ".", -1)
    return F.left(owner, F.length(owner) - F.length(simple) - F.lit(1)), simple


def resolve(needed: DataFrame, graph: CodeGraph) -> DataFrame:
    """``needed(kind, owner, name, ...)``, distinct, with ``answer`` (NULL if unknown), ``repo`` and ``simple``.

    All kinds are looked up together, in two steps: the owner as a simple or a full name; then, for dotted owners
    not found so, the simple name within the repository of the module part, which is told by ``repo`` and ``simple``.
    Of several definitions the first by full name counts.
    """
    rows = _definitions(graph)
    answer = F.struct("expected", "type")
    anywhere = rows.withColumn("owner", F.explode(F.array_distinct(F.array("simple", "full"))))
    direct = first_per_key(anywhere.select(*HELD, answer.alias("_direct"), "place"), HELD, ["place"]).drop("place")
    step = cut_lineage(needed.join(direct, HELD, "left"))
    module, simple = _module_of("owner")
    missing = step.filter(F.col("_direct").isNull() & F.col("owner").contains(".")).select(*HELD, module.alias("module"), simple.alias("simple"))
    homes = owner_repository(missing.select("module"), graph)
    located = salted_join(missing, homes, ["module"], salt_on=["owner", "name"])
    members = rows.filter("kind <> 'function'").drop("repo").join(_class_homes(graph).withColumnRenamed("full_name", "full"), "full")
    local = members.unionByName(rows.filter("kind = 'function'")).select("kind", "repo", "simple", "name", answer.alias("_indirect"), "place")
    local = first_per_key(local, ["kind", "repo", "simple", "name"], ["place"]).drop("place")
    indirect = located.join(local, ["kind", "repo", "simple", "name"], "left").select(*HELD, "repo", "simple", "_indirect")
    joined = step.join(indirect, HELD, "left")
    return cut_lineage(joined.select(*needed.columns, F.coalesce("_direct", "_indirect").alias("answer"), "repo", "simple"))


def find_result_methods(
    methods: DataFrame, graph: CodeGraph, repo: str, parts: Sequence[str] = ("Result", "Stream", "Run")
) -> DataFrame:
    """First method of each wanted ``name`` on result-like classes of one repository."""
    like = F.lit(False)
    for part in parts:
        like = like | F.col("class_name").contains(part)
    inside = graph.class_files.filter(F.col("repo") == repo).select(F.col("full_name").alias("class_full_name")).distinct()
    rows = graph.methods.filter(like).join(inside, "class_full_name", "left_semi").withColumn("expected", _expected())
    first = first_per_key(rows.select("name", "expected", "return_type", "class_name", "id"), ["name"], ["id"])
    return methods.select("name").distinct().join(first, "name").drop("id")


def _expected() -> Column:
    return F.when(F.size("params_detailed") > 0, F.col("params_detailed")).otherwise(
        F.coalesce("params_list", _no_strings())
    )


def similar_methods(needed: DataFrame, graph: CodeGraph, limit: int = SUGGESTIONS, located: DataFrame | None = None) -> DataFrame:
    """``(owner, name, suggestions)``: methods of the class containing the first three characters.

    Without any, methods of a class of that simple name in the repository of the owner's module; ``located(owner,
    repo, simple)`` tells it, if the caller knows.  Joined on (class, substring), so a class with very many methods is
    not paired with all of its missing names, and listed once for each start of a name.
    """
    wanted = needed.select("owner", "name").distinct().withColumn("_gram", F.left("name", F.lit(SUGGESTION_PREFIX)))
    starts = wanted.select("owner", "_gram").distinct()
    if located is None:
        module, simple = _module_of("owner")
        dotted = starts.filter(F.col("owner").contains(".")).select("owner", module.alias("module"), simple.alias("simple")).distinct()
        located = dotted.join(owner_repository(dotted.select("module"), graph), "module").drop("module")
    grams = graph.methods.select(
        "class_name", "class_full_name", F.col("name").alias("candidate"), F.explode(_grams(F.col("name"))).alias("_gram")
    )
    by_class = grams.select(
        F.explode(F.array_distinct(F.array("class_name", "class_full_name"))).alias("owner"), "_gram", "candidate"
    )
    own = salted_join(by_class, starts, ["owner", "_gram"], salt_on=["candidate"]).select("owner", "_gram", F.lit(0).alias("_far"), "candidate")
    by_repo = grams.join(_class_homes(graph).withColumnRenamed("full_name", "class_full_name"), "class_full_name").select("repo", F.col("class_name").alias("simple"), "_gram", "candidate")
    asked = starts.join(located, "owner")
    nearby = salted_join(by_repo, asked, ["repo", "simple", "_gram"], salt_on=["candidate"]).select("owner", "_gram", F.lit(1).alias("_far"), "candidate")
    best = top_per_group(own.unionByName(nearby).distinct(), ["owner", "_gram"], [F.asc("_far"), F.asc("candidate")], limit, salt_on=["candidate"])
    listed = F.array_sort(F.collect_list(F.struct("_far", "rank", "candidate")))
    # Methods of the repository only where the class itself offers none.
    nearest = F.filter("_listed", lambda s: s["_far"] == F.col("_listed")[0]["_far"])
    lists = best.groupBy("owner", "_gram").agg(listed.alias("_listed")).select("owner", "_gram", F.transform(nearest, lambda s: s["candidate"]).alias("suggestions"))
    return wanted.join(lists, ["owner", "_gram"]).select("owner", "name", "suggestions")


# --- rules --------------------------------------------------------------------------------------------

VALIDATION_COLUMNS = [
    "script", "kind", "seq", "line", "name", "owner", "in_graph", "status", "confidence",
    "message", "suggestions", "param_status", "param_message", "expected_type",
]


def check_imports(imports: DataFrame, graph: CodeGraph) -> DataFrame:
    """Imports with ``search_module``, ``repo`` (NULL when external), ``status``, ``confidence``."""
    rows = imports.withColumn(
        "search_module", F.when(F.col("is_from_import"), F.col("module")).otherwise(F.col("name"))
    )
    modules = rows.select(F.col("search_module").alias("module")).distinct()
    with_files = graph.files.select("repo").distinct()
    homes = best_repository(modules, graph).join(with_files, "repo", "left_semi")
    joined = salted_join(rows, homes.select(F.col("module").alias("search_module"), "repo"), ["search_module"], "left", salt_on=["script", "seq"])
    known = F.col("repo").isNotNull()
    return joined.select(
        *rows.columns,
        "repo",
        F.when(known, "VALID").otherwise("UNCERTAIN").alias("status"),
        F.when(known, 0.9).otherwise(0.8).alias("confidence"),
        _note("module", F.col("search_module"), F.when(known, IN_GRAPH).otherwise(OUTSIDE)).alias("message"),
    )


def module_contents(checked: DataFrame, graph: CodeGraph) -> DataFrame:
    """``(search_module, kind, name)``: classes and functions of the repository behind each module."""
    homes = checked.filter(F.col("repo").isNotNull()).select("search_module", "repo").distinct()
    classes = graph.class_files.join(graph.classes, "full_name").select("repo", F.lit("class").alias("kind"), "name")
    functions = graph.functions.select("repo", F.lit("function").alias("kind"), "name")
    # Each repository's names once, spread over tasks before they meet its modules.
    names = classes.union(functions).distinct()
    return salted_join(names, homes, ["repo"], salt_on=["kind", "name"]).select("search_module", "kind", "name").distinct()


def graph_modules(checked: DataFrame) -> DataFrame:
    """``(script, base)``: first segments of the modules a script imports from the graph."""
    base = F.substring_index("search_module", ".", 1)
    return cut_lineage(checked.filter("status = 'VALID'").select("script", base.alias("base")).distinct())


def flag_in_graph(rows: DataFrame, modules: DataFrame, name: Column, out: str = "in_graph") -> DataFrame:
    """Whether a name comes from a module of the script's own graph imports."""
    flagged = rows.withColumn("base", F.substring_index(name, ".", 1))
    known = modules.withColumn("_known", F.lit(True))
    joined = salted_join(flagged, known, ["script", "base"], "left", salt_on=["seq"])
    return joined.withColumn(out, F.coalesce("_known", F.lit(False))).drop("_known", "base")


#: Outcomes as they are told after ``kind subject:``.
IN_GRAPH, OUTSIDE, ABSENT, UNTYPED, MISFIT = "known", "outside of the graph, not judged", "unknown", "type of the object is open", "known, arguments do not fit: "


def _note(kind: Column | str, subject: Column, outcome: Column | str, detail: Column | None = None) -> Column:
    """``kind subject: outcome`` with an optional detail."""
    told = outcome if isinstance(outcome, Column) else F.lit(outcome)
    named = kind if isinstance(kind, Column) else F.lit(kind)
    return F.concat(named, F.lit(" "), F.coalesce(subject, F.lit("?")), F.lit(": "), told, F.lit("") if detail is None else F.coalesce(detail, F.lit("")))


def _uses(rows: DataFrame, kind: str, name: str, owner: Column, tested: Column, shown: Column | None = None) -> DataFrame:
    """Usages of a kind in one shape; ``tested`` is the name that has to come from a module of the graph."""
    no_args, no_kwargs = F.lit(None).cast("array<string>"), F.lit(None).cast("map<string,string>")
    return rows.select(
        "script", F.lit(kind).alias("kind"), "seq", "line", F.col(name).alias("name"), owner.alias("owner"), tested.alias("tested"),
        (F.lit(None).cast("string") if shown is None else shown).alias("shown"),
        *((F.col(c) if c in rows.columns else empty).alias(c) for c, empty in (("args", no_args), ("kwargs", no_kwargs))),
    )


def class_uses(rows: DataFrame) -> DataFrame:
    owner = F.coalesce("full_class_name", "class_name")
    return _uses(rows, "class", "class_name", owner, owner)


def method_uses(rows: DataFrame) -> DataFrame:
    return _uses(rows, "method", "method_name", F.col("object_type"), F.col("object_type"), F.col("object_name"))


def attribute_uses(rows: DataFrame) -> DataFrame:
    return _uses(rows.drop("args", "kwargs"), "attribute", "attribute_name", F.col("object_type"), F.col("object_type"), F.col("object_name"))


def function_uses(rows: DataFrame) -> DataFrame:
    """Functions without a resolved full name are looked up by name, but never count as graph items."""
    return _uses(rows, "function", "function_name", F.coalesce("full_name", "function_name"), F.col("full_name"))


def _asked(kind: Column, name: Column) -> Column:
    """What has to be looked up for a usage: (kind, name, whether a missing one wants suggestions)."""

    def ask(k: str, n: Column, called: bool = False) -> Column:
        return F.struct(F.lit(k).alias("kind"), n.alias("name"), F.lit(called).alias("called"))

    none = F.lit("")
    return (
        F.when(kind == "class", F.array(ask("class", none), ask("method", F.lit("__init__"))))
        .when(kind == "method", F.array(ask("method", name, True)))
        .when(kind == "attribute", F.array(ask("attribute", name), ask("method", name)))
        .otherwise(F.array(ask("function", none)))
    )


def _answers(found: DataFrame, graph: CodeGraph) -> DataFrame:
    """Resolved definitions by the usages they answer: ``(kind, owner, asked_name, found, other, expected, type, suggestions)``.

    ``other`` is the constructor of a class, or the method of an attribute's name.
    """

    def part(kind: str, name: Column, main: bool) -> Column:
        return F.struct(F.lit(kind).alias("use"), name.alias("asked_name"), F.lit(main).alias("main"))

    name, none = F.col("name"), F.lit("")
    as_method = F.array(part("method", name, True), part("attribute", name, False))
    parts = (
        F.when((F.col("kind") == "method") & (name == "__init__"), F.concat(as_method, F.array(part("class", none, False))))
        .when(F.col("kind") == "method", as_method)
        .when(F.col("kind") == "attribute", F.array(part("attribute", name, True)))
        .when(F.col("kind") == "class", F.array(part("class", none, True)))
        .otherwise(F.array(part("function", none, True)))
    )
    dealt = found.select("owner", "answer", F.explode(parts).alias("p")).select(F.col("p.use").alias("kind"), "owner", "p.asked_name", "p.main", "answer")
    known, of_signature = F.col("answer").isNotNull(), F.col("main") == (F.col("kind") != "class")
    packed = dealt.groupBy("kind", "owner", "asked_name").agg(
        F.max(F.col("main") & known).alias("found"),
        F.max(~F.col("main") & known).alias("other"),
        F.first(F.when(of_signature, F.col("answer.expected")), ignorenulls=True).alias("expected"),
        F.first(F.when(F.col("main"), F.col("answer.type")), ignorenulls=True).alias("type"),
    )
    missing = found.filter("called AND answer IS NULL")
    located = missing.filter("repo IS NOT NULL").select("owner", "repo", "simple").distinct()
    near = similar_methods(missing, graph, located=located).select(F.lit("method").alias("kind"), "owner", F.col("name").alias("asked_name"), "suggestions")
    return packed.join(near, ["kind", "owner", "asked_name"], "left")


def check_uses(uses: DataFrame, modules: DataFrame, graph: CodeGraph) -> DataFrame:
    """Status, confidence and message of usages of any kind; hot owners are spread when the answers come back."""
    rows = flag_in_graph(uses, modules, F.col("tested"))
    kind, owner = F.col("kind"), F.col("owner")
    is_function, is_method, is_attribute, is_class = (kind == k for k in ("function", "method", "attribute", "class"))
    outside = ~F.col("in_graph") & (~is_function | F.col("tested").isNotNull())
    wanted = rows.filter(~outside & owner.isNotNull()).select("owner", F.explode(_asked(kind, F.col("name"))).alias("a"))
    needed = wanted.groupBy("a.kind", "owner", "a.name").agg(F.max("a.called").alias("called"))
    answers = _answers(resolve(needed, graph), graph)
    by_name = F.when(is_method | is_attribute, F.col("name")).otherwise("")
    rows = salted_join(rows.withColumn("asked_name", by_name), answers, ["kind", "owner", "asked_name"], "left", salt_on=["script", "seq"])
    rows = rows.withColumn("_p", pm.check_call(F.col("expected"), F.col("args"), F.col("kwargs")))

    found, other = F.coalesce("found", F.lit(False)), F.coalesce("other", F.lit(False))
    subject = F.when(is_method | is_attribute, F.concat_ws(".", "owner", "name")).otherwise(owner)
    known = found | (is_attribute & other)
    rules = [
        (owner.isNull() & (is_method | is_attribute), "UNCERTAIN", F.lit(0.3), _note("object", F.col("shown"), UNTYPED)),
        (outside, "UNCERTAIN", F.lit(0.8), _note(kind, owner, OUTSIDE)),
        (~known, "NOT_FOUND", F.when(is_method, 0.1).otherwise(0.2), _note(kind, subject, ABSENT)),
        (~is_attribute & (F.col("_p.status") == "INVALID"), "INVALID", F.col("_p.confidence"), _note(kind, subject, MISFIT, F.col("_p.message"))),
        (is_attribute & ~found, "VALID", F.lit(0.8), _note(kind, subject, "known as a method")),
        (F.lit(True), "VALID", F.when(is_method, 0.9).otherwise(0.8), _note(kind, subject, IN_GRAPH)),
    ]
    judged = rules[-1]
    verdict = F.struct(F.lit(judged[1]).alias("status"), judged[2].alias("confidence"), judged[3].alias("message"))
    for condition, status, confidence, message in reversed(rules[:-1]):
        verdict = F.when(condition, F.struct(F.lit(status).alias("status"), confidence.alias("confidence"), message.alias("message"))).otherwise(verdict)
    checked = ~outside & found & ~is_attribute
    no_signature = is_class & F.col("expected").isNull()
    rows = rows.withColumn("_verdict", verdict)
    shaped = {
        "status": F.col("_verdict.status"),
        "confidence": F.col("_verdict.confidence"),
        "message": F.col("_verdict.message"),
        "suggestions": F.when(is_method & F.col("in_graph") & ~found, F.coalesce("suggestions", _no_strings())).otherwise(_no_strings()),
        "param_status": F.when(checked, F.col("_p.status")),
        "param_message": F.when(checked, F.when(no_signature, "no signature of the constructor").otherwise(F.col("_p.message"))),
        "expected_type": F.when(is_attribute & F.col("in_graph"), F.when(found, F.col("type")).when(other, "method")),
    }
    return rows.select(*((shaped[c] if c in shaped else F.col(c)).alias(c) for c in VALIDATION_COLUMNS))


def check_instantiations(rows: DataFrame, modules: DataFrame, graph: CodeGraph) -> DataFrame:
    return check_uses(class_uses(rows), modules, graph)


def check_method_calls(rows: DataFrame, modules: DataFrame, graph: CodeGraph) -> DataFrame:
    return check_uses(method_uses(rows), modules, graph)


def check_attributes(rows: DataFrame, modules: DataFrame, graph: CodeGraph) -> DataFrame:
    return check_uses(attribute_uses(rows), modules, graph)


def check_functions(rows: DataFrame, modules: DataFrame, graph: CodeGraph) -> DataFrame:
    return check_uses(function_uses(rows), modules, graph)


def import_validations(checked: DataFrame) -> DataFrame:
    rows = checked.withColumn("owner", F.col("module")).withColumn("in_graph", F.col("status") == "VALID")
    null = F.lit(None).cast("string")
    shaped = rows.withColumns(
        {
            "kind": F.lit("import"),
            "suggestions": _no_strings(),
            "param_status": null,
            "param_message": null,
            "expected_type": null,
        }
    )
    return shaped.select(*VALIDATION_COLUMNS)


def validate(usage: Usage, graph: CodeGraph) -> tuple[DataFrame, DataFrame]:
    """All validations of all scripts in one long table, and the checked imports.

    Usages of all kinds are flagged, looked up and judged together.
    """
    checked = check_imports(usage.imports, graph)
    uses = class_uses(usage.instantiations).unionByName(method_uses(usage.method_calls))
    uses = uses.unionByName(attribute_uses(usage.attributes)).unionByName(function_uses(usage.functions))
    return import_validations(checked).unionByName(check_uses(uses, graph_modules(checked), graph)), checked
