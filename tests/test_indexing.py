import pytest

from strataflow.operators import resolve
from strataflow.plans.engine import Engine
from strataflow.plans.indexing import full_index, publish_batch
from strataflow.sources import configs
from strataflow.sources.extract import Registry, extract
from strataflow.sources.parse import ParseError, parse
from strataflow.sources.store import Store


def write(root, files):
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)


def state(store, version):
    nodes = {(r["source_path"], r["node_id"]) for r in store.contributions("nodes", version).collect()}
    return nodes, {tuple(r) for r in store.workspace("edges", version).select("source_id", "target_id", "relation", "confidence").collect()}


TREE = {
    "package.json": "{}",
    "a.ts": 'import { B } from "./b"\nexport class A extends B { run() { this.stop(); helper() } stop() {} }\nfunction helper() {}\n',
    "b.ts": "export class B {}\n",
    "c.ts": 'import { Alias } from "@lib/all"\nimport * as w from "widget"\nimport x from "./missing"\nAlias()\nw.open()\n',
    "d.ts": "export class D {}\n",
    "tsconfig.json": '{ // aliases\n "compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["lib/*"],}} }',
    "lib/all.ts": 'export { A as Alias } from "../a"\n',
    "widget/package.json": '{"name": "widget", "exports": {".": {"types": "./t.d.ts", "import": "./main.ts"}}}',
    "widget/main.ts": "export function open() {}\n",
    ".gitignore": "skipped.ts\n",
    "skipped.ts": "export class Skipped {}\n",
    "go/go.mod": "module example.org/app // the app\n\nreplace example.org/other => ./vendored\n",
    "go/main.go": 'package main\n\nimport (\n\tst "example.org/app/store"\n\t"example.org/other/x"\n)\n\nfunc main() {\n\ts := st.Open()\n\tst.hidden()\n\tx.Go()\n\tlocal()\n\t_ = s\n}\n\nfunc local() {}\n',
    "go/store/store.go": "package store\n\ntype Saver interface {\n\tSave()\n\tClose()\n}\n\ntype Disk struct {\n\tBase\n}\n\ntype Base struct{}\n\nfunc Open() *Disk { return nil }\nfunc hidden() {}\nfunc (d *Disk) Save() { d.Close() }\n",
    "go/store/close.go": "package store\n\nfunc (d *Disk) Close() {}\n",
    "go/vendored/x/x.go": "package x\n\nfunc Go() {}\n",
}


def test_full_index_resolves_and_incremental_equals_it(spark, tmp_path):
    src, tree = tmp_path / "src", f"file://{tmp_path}/src"
    write(src, TREE)
    store = Store(spark, f"file://{tmp_path}/store")
    assert full_index(spark, store, tree) == 1
    nodes, edges = state(store, 1)
    assert not any(p == "skipped.ts" for p, _ in nodes)
    main, disk = "go:function:go/main.go#main", "go:struct:go/store/store.go#Disk"
    for e in [
        ("file:a.ts", "typescript:class:b.ts#B", "typescript:imports_from", "extracted"),
        ("typescript:class:a.ts#A", "typescript:class:b.ts#B", "typescript:extends", "inferred"),
        ("typescript:class:a.ts#A", "typescript:method:a.ts#A.run", "contains", "extracted"),
        ("typescript:method:a.ts#A.run", "typescript:method:a.ts#A.stop", "typescript:calls", "inferred"),
        ("typescript:method:a.ts#A.run", "typescript:function:a.ts#helper", "typescript:calls", "inferred"),
        ("file:lib/all.ts", "file:a.ts", "typescript:re_exports", "extracted"),
        ("file:c.ts", "typescript:class:a.ts#A", "typescript:calls", "inferred"),
        ("file:c.ts", "typescript:function:widget/main.ts#open", "typescript:calls", "inferred"),
        (main, "go:function:go/store/store.go#Open", "go:calls", "inferred"),
        (main, "go:function:go/vendored/x/x.go#Go", "go:calls", "inferred"),
        (main, "go:function:go/main.go#local", "go:calls", "inferred"),
        ("go:method:go/store/store.go#Disk.Save", "go:method:go/store/close.go#Disk.Close", "go:calls", "inferred"),
        (disk, "go:struct:go/store/store.go#Base", "go:embeds", "inferred"),
        (disk, "go:interface:go/store/store.go#Saver", "go:implements", "inferred"),
        ("file:go/main.go", "file:go/store/close.go", "go:imports_from", "inferred"),
    ]:
        assert e in edges, e
    assert not any(b.endswith("#hidden") and r == "go:calls" for _, b, r, _ in edges)
    assert {r["specifier"] for r in store.workspace("diagnostics", 1).collect()} == {"./missing"}
    graph = store.contributions("nodes", 1).selectExpr("node_id", "kind", "label", "qualified_name", "source_path as span_path")
    asked = Engine(graph, store.workspace("edges", 1)).ask("who calls Close?")
    assert [e["edges"][0][0] for e in asked.evidence if e["distance"] == 1] == ["go:method:go/store/store.go#Disk.Save"]

    assert publish_batch(spark, store, tree, ["zzz.md", "../out.ts", "skipped.ts"]) == 1
    write(src, {"b.ts": "export class B2 {}\n", "missing.ts": "export default 1\n", "go/store/close.go": "package store\n"})
    (src / "d.ts").unlink()
    assert publish_batch(spark, store, tree, ["./b.ts", "d.ts", "missing.ts", "go/store/close.go"]) == 2
    # only what changed is written; dependents are resolved again from their stored references
    assert {r["source_path"] for r in store.intervals().filter("written = 2").collect()} == {"b.ts", "d.ts", "missing.ts", "go/store/close.go"}
    fresh = Store(spark, f"file://{tmp_path}/fresh")
    full_index(spark, fresh, tree)
    assert state(store, 2) == state(fresh, 1)


def test_parsers_read_structure_and_reject_broken_text(spark):
    ts = parse("m.ts", "typescript", "/** Doc. */\nexport class Foo<T> extends ns.Base<T> implements A, B {\n  private x = make();\n  async go(): Promise<void> { await b(1); const re = /a{2}\"/; }\n}\nexport { Foo as Bar }\nconst { z, w: v } = require('lib')\nimport(c ? './one' : './t' + 'wo')\n")
    by = {n["label"]: n for n in ts.nodes}
    assert (by["Foo"]["line"], by["Foo"]["end_line"], by["Foo"]["end_column"], by["Foo"]["comments"]) == (2, 5, 2, ["Doc."]) and by["go"]["owner"] == "Foo"
    assert [(t, r) for _, t, _, r, _ in ts.symbols] == [("ns.Base", "typescript:extends"), ("A", "typescript:implements"), ("B", "typescript:implements"), ("make", "typescript:calls"), ("b", "typescript:calls")]
    assert ("lib", "require", 7, False, [("z", "z"), ("w", "v")]) in ts.references and ("./two", "import", 8, True, []) in ts.references
    go = parse("m.go", "go", "package p\n// D keeps.\ntype D struct {\n\tq.Base\n\tname string\n}\ntype (\n\tA = D\n\tI interface { M() }\n)\nconst a, B = 1, 2\nfunc (d *D) M(o q.T) { o.N(); x := &D{}; x.M() }\n")
    kinds = {(n["kind"], n["label"], n["exported"]) for n in go.nodes}
    assert {("go:struct", "D", True), ("go:type_alias", "A", True), ("go:interface", "I", True), ("go:constant", "a", False), ("go:constant", "B", True), ("go:method", "M", True)} <= kinds
    assert [(t, v, r) for _, t, v, r, _ in go.symbols] == [("q.Base", "", "go:embeds"), ("M", "", "go:requires"), ("N", "q.T", "go:calls"), ("M", "D", "go:calls")]
    for language, text in (("go", "func f() {"), ("typescript", "const a = 'x"), ("javascript", "f(]")):
        with pytest.raises(ParseError):
            parse("x", language, text)
    sources = spark.createDataFrame([("ok.go", "go", "package p\n"), ("bad.go", "go", "func {")], "path string, language string, content string")
    with pytest.raises(Exception, match="does not close"):
        extract(sources).collect()
    assert {r["source_path"] for r in extract(sources, fail_fast=False).collect()} == {"ok.go"}


def test_registry_refuses_duplicates():
    r = Registry().register("go", [".go"], parse)
    for language, extensions in (("go2", [".go"]), ("go", [".g"]), ("x", ["x"])):
        with pytest.raises(ValueError):
            r.register(language, extensions, parse)


def test_configuration_rows():
    assert configs.rows("p/tsconfig.json", '{"compilerOptions": {"baseUrl": "src", "paths": {"@a/*": ["a/*", "b/*"]}}} // x') == [("alias", "p", "@a/*", "p/src/a/*", 0), ("base", "p", "", "p/src", 0), ("config", "p", "", "", 0)]
    assert configs.rows("n/package.json", '{"name": "n", "main": "lib/m.js"}') == [("package", "n", ".", "n/lib/m.js", 1), ("package", "n", ".", "n/index", 9), ("open_package", "n", "", "n", 0), ("named", "n", "n", "n", 0)]
    assert configs.rows("package.json", "{broken") == []
    assert configs.rows("go.mod", "module a.b/c\nreplace (\n\tx.y/z v1.2.3 => ../z\n\tq => r.s/t v1\n)\n") == [("module", "", "a.b/c", "", 0), ("module", "", "x.y/z", "../z", 1)]
    assert configs.rows("go.work", "go 1.2\nuse (\n\t./a\n\t./b\n)\n") == [("use", "", "", "a", 0), ("use", "", "", "b", 0)]


def test_packages_and_aliases(spark):
    config = spark.createDataFrame([("package", "node_modules/lib", ".", "node_modules/lib/m.js", 1), ("package", "a/node_modules/lib", ".", "a/node_modules/lib/near.js", 0), ("package", "node_modules/lib", "./sub", "node_modules/lib/s.js", 0), ("open_package", "node_modules/@s/p", "", "node_modules/@s/p", 0), ("config", "a", "", "", 0), ("alias", "a", "~x", "a/exact", 0), ("alias", "a", "~x*", "a/star/*", 1), ("config", "a/b", "", "", 0), ("base", "a/b", "", "a/b/src", 0)], configs.SCHEMA)
    refs = spark.createDataFrame([("a/f.ts", "lib"), ("f.ts", "lib"), ("f.ts", "lib/sub"), ("f.ts", "@s/p/deep"), ("a/f.ts", "~x"), ("a/f.ts", "~xy"), ("a/b/f.ts", "q"), ("f.ts", "nothing")], "source_path string, specifier string")
    files = spark.createDataFrame([(p,) for p in ("node_modules/lib/m.js", "a/node_modules/lib/near.js", "node_modules/lib/s.js", "node_modules/@s/p/deep.ts", "a/exact.ts", "a/star/y/index.ts", "a/b/src/q.tsx")], "path string")
    got = {(r["source_path"], r["specifier"]): r["target_path"] for r in resolve.script_targets(refs, files, config).collect()}
    assert got == {("a/f.ts", "lib"): "a/node_modules/lib/near.js", ("f.ts", "lib"): "node_modules/lib/m.js", ("f.ts", "lib/sub"): "node_modules/lib/s.js", ("f.ts", "@s/p/deep"): "node_modules/@s/p/deep.ts", ("a/f.ts", "~x"): "a/exact.ts", ("a/f.ts", "~xy"): "a/star/y/index.ts", ("a/b/f.ts", "q"): "a/b/src/q.tsx", ("f.ts", "nothing"): None}
