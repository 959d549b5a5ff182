import pytest

from sparkloom.operators import extract, resolve, skeleton
from sparkloom.sources import files as sources

CODE = {
    "src/geo.rs": ("use std::sync::{Arc, Mutex as M};\n\n/// A place\npub struct Spot {\n    x: f64,\n    y: f64,\n}\n\nimpl Spot {\n    /// Makes one\n    pub fn new(x: f64, y: f64) -> Spot {\n        Spot { x, y }\n    }\n    fn far(&self) -> f64 {\n        norm(self.x, self.y)\n    }\n}\n\nfn norm(a: f64, b: f64) -> f64 {\n    println!(\"{}\", a);\n    (a * a + b * b).sqrt()\n}\n"),
    "app/calc.py": ("import os\nfrom .util import helper as h\n\nclass Calc(Base):\n    \"\"\"Adds.\"\"\"\n    rate = 1\n\n    def add(self, a: int, b: int) -> int:\n        return h(a) + os.getpid()\n\ndef main():\n    c = Calc()\n    c.add(1, 2)\n"),
    "web/car.js": ("import x from './part.js';\nclass Car extends Base {\n  constructor(make) {\n    this.make = make;\n  }\n  go(n) {\n    log(n);\n  }\n}\nconst twice = (n) => {\n  return go(n);\n};\nfunction start() {\n  twice(2);\n}\n"),
    "web/person.ts": ("interface Named {\n  id: number;\n  name: string;\n}\nenum Color { Red, Green }\nclass Person implements Named {\n  private age: number;\n  getAge(): number {\n    return compute(this.age);\n  }\n}\n"),
    "srv/main.go": ("package main\n\nimport (\n\t\"fmt\"\n)\n\ntype Point struct {\n\tX int\n\tY int\n}\n\nfunc (p Point) Move(d int) int {\n\treturn p.X + d\n}\n\nfunc main() {\n\tfmt.Println(NewPoint(1).Move(2))\n}\n"),
    "j/Person.java": ("package j;\nimport java.util.List;\npublic class Person {\n  private String name;\n  public Person(String name) {\n    this.name = name;\n  }\n  public String getName() {\n    return clean(name);\n  }\n  static void run() {\n    new Person(\"a\").getName();\n  }\n}\n"),
    "c/shape.cpp": ("#include <cmath>\nclass Circle : public Shape {\npublic:\n  double radius;\n  Circle(double r) : radius(r) {}\n  double area() override {\n    return square(radius) * 3.14;\n  }\n};\nint main() {\n  Circle c(1);\n  return c.area();\n}\n"),
}


@pytest.fixture(scope="module")
def tables(spark):
    files = sources.files_from_rows(spark, list(CODE.items()))
    symbols = extract.extract(files).cache()
    return files, symbols


def names(symbols, path, kind):
    return [r["name"] for r in symbols.where(f"file_path = '{path}' and kind = '{kind}'").orderBy("start_row", "start_byte").collect()]


@pytest.mark.parametrize(
    ("path", "functions", "structs", "fields", "calls"),
    [
        ("src/geo.rs", ["new", "far", "norm"], ["Spot", "Spot"], ["x", "y"], ["Spot", "norm", "sqrt"]),
        ("app/calc.py", ["add", "main"], ["Calc"], ["rate"], ["h", "getpid", "Calc", "add"]),
        ("web/car.js", ["constructor", "go", "twice", "start"], ["Car"], [], ["log", "go", "twice"]),
        ("web/person.ts", ["getAge"], ["Named", "Color", "Person"], ["id", "name", "Red", "Green", "age"], ["compute"]),
        ("srv/main.go", ["Move", "main"], ["Point"], ["X", "Y"], ["Println", "NewPoint", "Move"]),
        ("j/Person.java", ["Person", "getName", "run"], ["Person"], ["name"], ["clean", "Person", "getName"]),
        ("c/shape.cpp", ["Circle", "area", "main"], ["Circle"], ["radius"], None),
    ],
)
def test_symbols(tables, path, functions, structs, fields, calls):
    _, symbols = tables
    assert names(symbols, path, "function") == functions
    assert names(symbols, path, "struct") == structs
    assert names(symbols, path, "field") == fields
    if calls is not None:
        assert names(symbols, path, "call") == calls


def test_imports_and_signatures(tables):
    files, symbols = tables
    imports = {(r["name"], r["import_type"], r["alias"]) for r in symbols.where("kind = 'import'").collect()}
    assert {("Arc", "System", None), ("Mutex", "System", "M"), ("os", "System", None), ("helper", "UserModule", "h"), ("part.js", "UserModule", None), ("fmt", "System", None), ("cmath", "System", None)} <= imports
    f = extract.functions_of(symbols, files)
    add = f.where("name = 'add'").first()
    assert (add.line_start, add.line_end, add.language, add.namespace, add.signature) == (8, 9, "python", "global", "add()")
    again = {r["id"] for r in extract.functions_of(extract.extract(files), files).collect()}
    assert again == {r["id"] for r in f.collect()}


def test_calls_are_resolved(tables):
    files, symbols = tables
    f = extract.functions_of(symbols, files)
    calls = resolve.build_calls(extract.call_sites(symbols), f)
    got = {(r["caller_name"], r["callee_name"], r["is_resolved"]) for r in calls.collect()}
    assert {("far", "norm", True), ("main", "add", True), ("start", "twice", True), ("getName", "clean", False), ("run", "getName", True)} <= got
    assert {r["name"] for r in resolve.placeholders(calls).collect()} >= {"clean", "sqrt"}


def test_skeletons(tables):
    _, symbols = tables
    text = dict(skeleton.file_skeletons(symbols).select("file_path", "skeleton_text").collect())
    assert text["src/geo.rs"].startswith("pub struct Spot {\n  x: f64,\n  y: f64,\n}\n\nimpl Spot {\n  pub fn new(x: f64, y: f64) -> Spot { ... }\n  fn far(&self) -> f64 { ... }\n}")
    assert text["app/calc.py"].startswith("class Calc(Base)\n  rate = 1\n  def add(self, a: int, b: int) -> int\n    ...\n")
    assert "class Person implements Named {\n  private age: number;\n  getAge(): number { ... }\n}" in text["web/person.ts"]
    d = {r["line"] for r in skeleton.declarations(symbols).collect()}
    assert "/// A place\npub struct Spot { ... }" in d
    assert 'class Calc(Base)\n    """Adds."""\n    ...' in d


def test_broken_files_do_not_stop_a_run(spark):
    files = sources.files_from_rows(spark, [("a.py", "def ok():\n    run()\n  broken(:\n"), ("b.rs", "fn half( {"), ("c.js", "'unclosed"), ("d.go", ""), ("e.txt", "x")])
    symbols = extract.extract(files)
    assert {r["kind"] for r in symbols.collect()} & {"error"} == set()
    assert names(symbols, "a.py", "function") == ["ok"]


def test_chunks(tables):
    _, symbols = tables
    c = extract.chunks_of(symbols)
    assert c.where("snippet_id = 'srv/main.go#12#Move'").first()["symbol_type"] == "FunctionDeclaration"
    classes = extract.classes_of(symbols, tables[0])
    row = classes.where("name = 'Car'").first()
    assert (row.parent_class, len(row.member_functions)) == ("Base", 2)
    assert extract.entity_edges(classes, symbols).where("edge_type = 'Contains'").count() > 5
