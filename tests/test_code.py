import pytest
from pyspark.sql import functions as F

from chartula.functions import params as pm
from chartula.operators import code_facts, keywords, usage_checks, usage_facts, usage_reports
from chartula.operators import code_graph as cg
from chartula.plans import validate as vp
from chartula.session import cut_lineage
from chartula.sources import reports

CORE = '''
import os
import shop.util
from . import sibling
from .base import Base
from numpy import array

class Cart(Base):
    total: float = 0.0
    items: List["Item"]
    _hidden: int
    count = 1

    def __init__(self, owner: str):
        self.owner = owner

    def add(self, item: Item, amount: int = 1, *extra, gift, note=None, **more: Any) -> "Cart":
        def nested(x): ...
        return self

    def add_all(self, items=[]): ...

    async def submit(self): ...

    def _private(self): ...

    class Inner:
        def deep(self, a, /, b: int | None, c: Optional[Tuple[int, str]] = (1,)) -> None: ...

def make(owner, size: "int" = os.sep, flags={}): ...

def _secret(): ...

class Cart:
    def add(self): ...
'''

FILES = [
    ("shop", "src/shop/__init__.py", ""),
    ("shop", "src/shop/core.py", CORE),
    ("shop", "src/shop/util.py", "def helper(a, b=2, *, key): ...\nclass Result:\n    size: int\n    def rows(self): ...\n"),
    ("shop", "lib/tool.py", "import shop.core\n"),
    ("shop", "broken.py", "def (:\n"),
    ("other-repo", "src/shop/core.py", "class Cart:\n    def other(self): ...\n"),
    ("other-repo", "main.py", "x = 1\ny = 2\n"),
    ("empty", "notes.py", "# nothing\n"),
]


@pytest.fixture(scope="module")
def graph(spark):
    files = spark.createDataFrame(FILES, "repo string, path string, content string")
    return vp.graph_from_files(files)


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_files_and_modules(graph):
    assert rows(graph.files, "repo", "path", "module_name", "line_count") == {
        ("shop", "src/shop/__init__.py", "shop.__init__", 0),
        ("shop", "src/shop/core.py", "shop.core", len(CORE.splitlines())),
        ("shop", "src/shop/util.py", "shop.util", 4),
        ("shop", "lib/tool.py", "tool", 1),
        ("other-repo", "src/shop/core.py", "shop.core", 2),
        ("other-repo", "main.py", "main", 2),
        ("empty", "notes.py", "notes", 1),
    }
    assert rows(graph.repositories, "repo") == {("shop",), ("other-repo",), ("empty",)}


def test_definitions(graph):
    methods = {r.id: r for r in graph.methods.collect()}
    assert set(methods) == {
        "shop.core.Cart::add", "shop.core.Cart::add_all", "shop.core.Cart::submit", "shop.core.Cart::other",
        "shop.core.Inner::deep", "shop.util.Result::rows",
    }
    # Defined by two repositories under one name: the first repository in order wins per method.
    add = methods["shop.core.Cart::add"]
    assert add.params_detailed == [
        "item:Item", "amount:int=1", "[var_positional] *extra:Any=None", "[keyword_only] gift:Any",
        "[keyword_only] note:Any=None", "[var_keyword] **more:Any=None",
    ]
    assert (add.return_type, add.args, add.params_list[:2]) == ("Cart", ["item", "amount"], ["item:Item", "amount:int"])
    deep = methods["shop.core.Inner::deep"]
    assert (deep.params_detailed, deep.return_type) == (["b:Any", "c:Optional[Tuple[int, str]]=..."], "None")
    assert rows(graph.attributes, "id", "type") == {
        ("shop.core.Cart::total", "float"), ("shop.core.Cart::items", "List['Item']"), ("shop.util.Result::size", "int"),
    }
    functions = {(r.repo, r.name): r.params_detailed for r in graph.functions.collect()}
    assert functions == {
        ("shop", "make"): ["owner:Any", "size:int=os.sep", "flags:Any={}"],
        ("shop", "nested"): ["x:Any"],
        ("shop", "helper"): ["a:Any", "b:Any=2", "[keyword_only] key:Any"],
    }
    assert rows(graph.class_files, "repo", "full_name") == {
        ("shop", "shop.core.Cart"), ("shop", "shop.core.Inner"), ("shop", "shop.util.Result"), ("other-repo", "shop.core.Cart"),
    }


def test_imports(graph):
    assert rows(graph.imports, "repo", "path", "import_name") == {
        ("shop", "src/shop/core.py", "shop.util"), ("shop", "src/shop/core.py", "base"), ("shop", "lib/tool.py", "shop.core"),
    }
    assert rows(cg.import_edges(graph), "path", "target_repo", "target_path") == {
        ("src/shop/core.py", "shop", "src/shop/util.py"),
        ("lib/tool.py", "shop", "src/shop/core.py"),
        ("lib/tool.py", "other-repo", "src/shop/core.py"),
    }


def test_package_roots_come_from_all_files(spark):
    files = [("r", "src/pkg/__init__.py", "def (:\n"), ("r", "src/pkg/sub/mod.py", "class A: ...\n")]
    graph = vp.graph_from_files(spark.createDataFrame(files, "repo string, path string, content string"))
    assert rows(graph.files, "module_name") == {("pkg.sub.mod",)} and rows(graph.classes, "full_name") == {("pkg.sub.mod.A",)}


def test_names_that_share_a_prefix(spark):
    """10,000 names with one beginning: every part meets the names that hold it, and few others are looked at."""
    wholes = spark.range(10_000).select(F.concat(F.lit("common-prefix-of-all-"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("whole"))
    parts = spark.createDataFrame([("prefix-of-all-00007",), ("all-0999",), ("7777",), ("l-12345x",), ("x",), ("common-prefix-of-all-00042-and-more",)], "part string")
    found = {}
    for r in keywords.contained(parts, wholes).collect():
        found.setdefault(r.part, set()).add(r.whole.removeprefix("common-prefix-of-all-"))
    assert found == {"prefix-of-all-00007": {"00007"}, "all-0999": {f"0999{n}" for n in range(10)}, "7777": {f"{n:05}" for n in range(10_000) if "7777" in f"{n:05}"}, "x": {f"{n:05}" for n in range(10_000)}}


def test_statistics_keep_empty_repositories(graph):
    stats = {r.repo: r for r in cg.repository_stats(graph).collect()}
    assert (stats["empty"].files, stats["empty"].classes, stats["empty"].methods) == (1, 0, 0)
    assert (stats["shop"].files, stats["shop"].classes, stats["shop"].functions, stats["shop"].attributes) == (4, 3, 3, 3)
    assert stats["shop"].sample_modules == ["shop.__init__", "shop.core", "shop.util", "tool"]


def test_constructor_option(spark):
    files = spark.createDataFrame([("r", "m.py", CORE)], "repo string, path string, content string")
    kept = cg.build_graph(code_facts.extract_definitions(files, include_init=True)).methods
    assert kept.filter("name = '__init__'").first().params_detailed == ["owner:str"]


def test_replacing_repositories(spark, graph):
    files = [("shop", "src/shop/new.py", "class Fresh:\n    def go(self): ...\n")]
    rebuilt = vp.graph_from_files(spark.createDataFrame(files, "repo string, path string, content string"))
    cleared = spark.createDataFrame([("shop",), ("empty",)], "repo string")
    swapped = cg.replace_repositories(graph, rebuilt, cleared)
    assert rows(swapped.files, "repo", "path") == {
        ("shop", "src/shop/new.py"), ("other-repo", "src/shop/core.py"), ("other-repo", "main.py"),
    }
    assert rows(swapped.classes, "full_name") == {("shop.new.Fresh",), ("shop.core.Cart",)}
    assert rows(swapped.functions, "repo") == set()


SCRIPT = """import numpy as np
from shop.core import Cart, make as build
from shop.util import helper

cart = Cart("me")
cart.add(1, gift=True)
cart.add()
cart.add(1, gift=1, other=2)
cart.add(1)
cart.submit(1)
cart.ship()
print(cart.total)
print(cart.colour)
cart.adr
@cart.submit
def f(): ...
helper(1)
helper(1, key=2)
helper(1, key=2, bad=3)
build("a")
build()
np.array([1]).sum()
unknown.call()
late.add_all()
late = Cart()
res = cart.add(1, gift=1)
res.rows()
with cart.submit() as handle:
    handle.close()
Widget(size=1)
"""


@pytest.fixture(scope="module")
def run(spark, graph):
    scripts = spark.createDataFrame(
        [("main", SCRIPT), ("external", "import requests\nrequests.get('x')\n"), ("bad", "def (:\n")], "script string, content string"
    )
    return vp.validate_scripts(scripts, graph)


def test_validations(run):
    got = {}
    for r in run.validations.filter("script = 'main'").collect():
        got.setdefault((r.kind, r.line, r.name), []).append((r.status, r.confidence, r.param_status))
    assert got[("import", 2, "Cart")] == [("VALID", 0.9, None)]
    assert got[("import", 1, "numpy")] == [("UNCERTAIN", 0.8, None)]
    assert got[("class", 5, "Cart")] == [("VALID", 0.8, "UNCERTAIN")]
    assert got[("class", 30, "Widget")] == [("UNCERTAIN", 0.8, None)]
    assert got[("method", 6, "add")] == [("VALID", 0.9, "VALID")]
    assert got[("method", 7, "add")] == [("INVALID", 0.8, "INVALID")]  # too few positional
    assert got[("method", 8, "add")] == [("VALID", 0.9, "VALID")]  # ** takes the unknown keyword
    assert got[("method", 9, "add")] == [("INVALID", 0.8, "INVALID")]  # keyword-only missing
    assert got[("method", 10, "submit")] == [("VALID", 0.9, "UNCERTAIN")]  # no parameters known
    assert got[("method", 11, "ship")] == [("NOT_FOUND", 0.1, None)]
    assert got[("method", 24, "add_all")] == [("VALID", 0.9, "VALID")]  # typed by the later assignment
    assert got[("method", 23, "call")] == [("UNCERTAIN", 0.3, None)]
    assert got[("method", 27, "rows")] == [("UNCERTAIN", 0.8, None)]  # result of a method
    assert got[("method", 29, "close")] == [("UNCERTAIN", 0.8, None)]
    assert got[("attribute", 12, "total")] == [("VALID", 0.8, None)]
    assert got[("attribute", 13, "colour")] == [("NOT_FOUND", 0.2, None)]
    assert got[("attribute", 15, "submit")] == [("VALID", 0.8, None)]  # a method used as decorator
    assert got[("function", 17, "helper")] == [("INVALID", 0.8, "INVALID")]
    assert got[("function", 18, "helper")] == [("VALID", 0.8, "VALID")]
    assert got[("function", 19, "helper")] == [("INVALID", 0.7, "INVALID")]
    assert got[("function", 20, "build")] == [("VALID", 0.8, "VALID")]
    assert got[("function", 21, "build")] == [("INVALID", 0.8, "INVALID")]
    assert got[("function", 12, "print")] == [("NOT_FOUND", 0.2, None)]


def test_findings_and_reports(run, tmp_path, spark):
    found = rows(usage_reports.findings(run.validations), "script", "type", "line")
    assert found == {
        ("main", "METHOD_NOT_FOUND", 11), ("main", "ATTRIBUTE_NOT_FOUND", 13), ("main", "ATTRIBUTE_NOT_FOUND", 14),
        ("main", "INVALID_PARAMETERS", 7), ("main", "INVALID_PARAMETERS", 9),
    }
    heads = {r.script: r for r in run.reports.collect()}
    assert heads["external"].overall_confidence == 1.0
    assert heads["external"].recommendations == [usage_reports.NO_FINDINGS]
    assert heads["bad"].total_validations == 0
    main = heads["main"]
    items = [r.confidence for r in run.validations.filter("script = 'main' AND in_graph").collect()]
    assert main.overall_confidence == pytest.approx(sum(items) / len(items))
    assert main.hallucinations == 5 and len(main.recommendations) == 3
    assert main.valid_count + main.invalid_count + main.not_found_count + main.uncertain_count == main.total_validations
    total = usage_reports.batch_summary(run.reports).first()
    assert (total.total_scripts, total.total_hallucinations) == (3, 5)
    assert [r.script for r in usage_reports.worst_scripts(run.reports, 1).collect()] == ["main"]
    reports.write_reports(run.reports, run.validations, str(tmp_path))
    assert spark.read.json(str(tmp_path / "findings")).count() == 5
    nested = reports.nested_reports(run.reports, run.validations, ["main"]).first()
    assert len(nested.validation_details) == main.total_validations


def test_library_usage(run):
    used = rows(usage_reports.library_usage(run.validations).filter("module = 'shop.util'"), "kind", "name", "status")
    assert used == {("import", None, "VALID"), ("function", "helper", "INVALID"), ("function", "helper", "VALID")}


def test_modules_do_not_leak_between_scripts(spark, graph):
    scripts = spark.createDataFrame(
        [("a", "import shop\n"), ("b", "import shopping\nx = shop.Cart()\nshop.run()\n")], "script string, content string"
    )
    rows_ = vp.validate_scripts(scripts, graph).validations
    assert rows_.filter("script = 'b' AND in_graph").count() == 0


def test_async_scope_types(spark):
    source = (
        "from pydantic_ai import Agent\nagent = Agent('m')\nasync def main():\n"
        "    async with agent.run_stream('q') as result:\n        await result.get()\n"
        "    async with agent.other() as reply:\n        reply.get()\nresult.outside()\n"
    )
    frame = spark.createDataFrame([("s", source)], "script string, content string")
    usage = usage_facts.usage_tables(code_facts.extract_usage(frame))
    typed = {(r.line, r.method_name): r.object_type for r in usage.method_calls.collect()}
    assert typed == {
        (4, "run_stream"): "pydantic_ai.Agent", (5, "get"): "pydantic_ai.StreamedRunResult", (6, "other"): "pydantic_ai.Agent",
        (7, "get"): None, (8, "outside"): None,
    }


def test_names_of_all_scripts_are_not_broadcast(spark):
    # Small as files, as generated scripts are, whatever number of events they hold.
    source = "import os.path\nimport shop as s\nfrom shop import Cart\nc = Cart()\nc.add(1)\nprint(s.size)\n"
    scripts = spark.range(3).select(F.when(F.col("id") > 0, F.concat(F.lit("s"), F.col("id"))).alias("script"), F.lit(source).alias("content"))
    usage = usage_facts.usage_tables(cut_lineage(code_facts.extract_usage(scripts)))
    for frame in (usage.instantiations, usage.functions, usage.method_calls, usage.attributes):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
    assert rows(usage.instantiations, "script", "class_name", "full_class_name") == {(None, "Cart", None), ("s1", "Cart", "shop.Cart"), ("s2", "Cart", "shop.Cart")}
    assert rows(usage.functions, "script", "function_name", "full_name") == {(s, "print", None) for s in (None, "s1", "s2")}
    assert rows(usage.method_calls, "script", "method_name", "object_type") == {(None, "add", "Cart"), ("s1", "add", "shop.Cart"), ("s2", "add", "shop.Cart")}


def test_dotted_names_by_shuffle(spark):
    names = spark.createDataFrame([("a", "os.path.join"), ("a", "os.path"), ("a", "np"), ("b", "os.path"), (None, "np")], "script string, name string")
    known = spark.createDataFrame([("a", "os.path", "os.path"), ("a", "os", "os"), ("a", "np", "numpy"), (None, "np", "numpy")], "script string, key string, full string")
    found = usage_facts.resolve_names(names, known, "name", "full")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found, "script", "name", "full") == {
        ("a", "os.path.join", "os.path.join"), ("a", "os.path", "os.path"), ("a", "np", "numpy"), ("b", "os.path", None), (None, "np", None),
    }


def test_suggestions_and_result_methods(spark, graph):
    needed = spark.createDataFrame([("shop.core.Cart", "addition"), ("shop.Cart", "submission"), ("Cart", "zzz")], "owner string, name string")
    got = {(r.owner, r.name): r.suggestions for r in usage_checks.similar_methods(needed, graph).collect()}
    assert got == {("shop.core.Cart", "addition"): ["add", "add_all"], ("shop.Cart", "submission"): ["submit"]}
    names = spark.createDataFrame([("rows",), ("add",)], "name string")
    assert rows(usage_checks.find_result_methods(names, graph, "shop"), "name", "class_name") == {("rows", "Result")}


def test_owner_repository_by_containment(spark, graph):
    modules = spark.createDataFrame([("shop.core",), ("my_shop_x",), ("other_repo",), ("repo",), ("absent",)], "module string")
    got = {r.module: r.repo for r in usage_checks.owner_repository(modules, graph).collect()}
    assert got == {"shop.core": "other-repo", "my_shop_x": "shop", "other_repo": "other-repo", "repo": "other-repo"}


def expected_check(params, n_args, keys):
    """The call rule, stated plainly."""
    if not params:
        return "UNCERTAIN", 0.5
    kinds = []
    for p in params:
        kind = p[1 : p.index("]")] if p.startswith("[") else "positional"
        body = p.split("] ", 1)[-1]
        kinds.append((kind, body.split(":")[0], "=" in body, body))
    plain = [k for k in kinds if not k[3].startswith("*")]
    positional = [k for k in plain if k[0] != "keyword_only"]
    required = [k for k in positional if not k[2]]
    if not any(k[3].startswith("*") and not k[3].startswith("**") for k in kinds) and n_args > len(positional):
        return "INVALID", 0.8
    if n_args < len(required):
        return "INVALID", 0.8
    if set(keys) - {k[1] for k in plain} and not any(k[3].startswith("**") for k in kinds):
        return "INVALID", 0.7
    if {k[1] for k in plain if k[0] == "keyword_only" and not k[2]} - set(keys):
        return "INVALID", 0.8
    return "VALID", 0.9


def test_call_rule_on_random_calls(spark):
    import random

    rnd = random.Random(6)
    pool = ["a:int", "b:str=1", "c:Any=None", "[var_positional] *args:Any=None", "[keyword_only] k:int", "[keyword_only] o:int=2", "[var_keyword] **kw:Any=None"]
    cases = []
    for i in range(400):
        params = [p for p in pool if rnd.random() < 0.5]
        keys = [k for k in ["a", "b", "k", "o", "zz"] if rnd.random() < 0.3]
        cases.append((i, params, ["1"] * rnd.randint(0, 4), {k: "1" for k in keys}))
    frame = spark.createDataFrame(cases, "i int, params array<string>, args array<string>, kwargs map<string,string>")
    checked = frame.select("i", pm.check_call(F.col("params"), F.col("args"), F.col("kwargs")).alias("c"))
    got = {r.i: (r.c.status, r.c.confidence) for r in checked.collect()}
    assert got == {i: expected_check(p, len(a), k) for i, p, a, k in cases}
