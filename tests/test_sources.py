"""Readers of source trees, and the graph that comes out of one."""

from grafspan import config
from grafspan.graph import Store
from grafspan.plans import build
from grafspan.sources import endpoints, files, java

JAVA = b"""package p;
import q.Helper;
@RestController @RequestMapping("/api")
public class A extends Base implements Face {
  @Autowired private Repo repo;
  private RestTemplate rest;
  @GetMapping({"/x/{id}", "/y"}) public String get(Long id) {
    go(); repo.find(id); rest.getForObject("/api/x/" + id, String.class);
    Helper h = new Helper(1); h.run(); list.map(A::conv);
    Runnable r = new Runnable() { public void run() { inner(); } };
    return unknown().y();
  }
  public void go() { helper(1); helper(1, 2); }
  void helper(int a) {} void helper(int a, int b) {}
  static int conv(Object o) { return 1; }
}
class Base { void up() {} }
interface Face { void go(); }
@Repository class Repo { Object find(Long id) { return null; } }
"""
KOTLIN = b"""package k
@Service
class Svc(private val repo: Repo) : Base(), Face {
  var isOpen: Boolean = false
  fun load(id: Long): Item? { return repo.find(id) }
}
data class D(val a: Int)
fun top(x: Int) = x + 1
"""


def test_java_records():
    u = java.read(JAVA, "A.java")
    assert not u.parse_error and u.package == "p"
    assert [t["fqn"] for t in u.types][:2] == ["p.A", f"p.A.<anon:{JAVA.index(b'new Runnable')}>"]
    assert u.types[0]["extends"] == ["Base"] and u.types[0]["implements"] == ["Face"]
    signatures = {m["fqn"] for m in u.members}
    assert {"p.A#get(Long)", "p.A#helper(int)", "p.A#helper(int,int)", "p.A#<init>()", "p.Base#<init>()"} <= signatures
    calls = {(c["receiver"], c["callee"], c["arg_count"]) for c in u.calls if c["caller_fqn"] == "p.A#get(Long)"}
    assert {("", "go", 0), ("repo", "find", 1), ("Helper", "<init>", 1), ("h", "run", 0), ("A", "conv", -1), ("unknown()", "y", 0)} <= calls
    assert ("", "inner", 0) not in calls


def test_broken_source_keeps_what_can_be_read():
    u = java.read(b"package p; class A { void f( { } class B { int x; }", "A.java")
    assert u.parse_error and "p.A" in {t["fqn"] for t in u.types}
    assert java.read(b"\xff\xfe{{{", "B.java").parse_error
    assert java.read(b"", "C.java").types == []


def test_kotlin_records():
    u = java.read(KOTLIN, "src/utils.kt")
    kinds = {t["fqn"]: t["kind"] for t in u.types}
    assert kinds == {"k.Svc": "class", "k.D": "record", "k.UtilsKt": "class"}
    assert {"k.Svc#isOpen()", "k.Svc#setOpen(Boolean)", "k.Svc#load(Long)", "k.UtilsKt#top(Int)", "k.D#getA()"} - {m["fqn"] for m in u.members} <= {"k.D#getA()"}
    svc = next(t for t in u.types if t["name"] == "Svc")
    assert (svc["extends"], svc["implements"]) == (["Base"], ["Face"])


def test_endpoints():
    u = java.read(JAVA, "A.java")
    types = {t["fqn"]: t for t in u.types}
    assert sorted(r["path"] for r in endpoints.routes(types, u.members)) == ["/api/x/{id}", "/api/y"]
    out = endpoints.outgoing(types, u.members, u.fields, u.scope, u.calls)
    assert [(c["path_template_call"], c["confidence"], c["method_call"]) for c in out] == [("/api/x/", 0.7, "GET")]
    assert endpoints.atoms('{"a", X.Y, "${z}"}') == [("a", "annotation", 1.0, True), ("X.Y", "constant_ref", 0.7, False), ("${z}", "spel", 0.85, False)]
    k = java.read(b'class L { @KafkaListener(topics = "t") void on(String s) {} }', "L.java")
    r = endpoints.routes({t["fqn"]: t for t in k.types}, k.members)
    assert [(x["topic"], x["broker"], x["kind"]) for x in r] == [("t", "kafka", "kafka_topic")]


def test_ignore_rules(spark):
    rules = files.BUILTIN + files.rules_of("*.log\n/gen/\n!keep.log\n# no\n", "project")
    paths = ["a/b.log", "keep.log", "gen/x.java", "src/gen/x.java", ".git/config", "a/.idea/x"]
    got = {r["path"]: (r["ignored"], r["pattern"]) for r in files.explained(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()}
    assert got == {"a/b.log": (True, "*.log"), "keep.log": (False, "!keep.log"), "gen/x.java": (True, "/gen/"), "src/gen/x.java": (False, None), ".git/config": (True, ".git/"), "a/.idea/x": (True, ".idea/")}
    tree = spark.createDataFrame([(p,) for p in ("m/pom.xml", "m/target/A.java", "m/src/target/B.java", "n/build/C.java")], "path string")
    assert {r["path"] for r in files.without_build_output(tree).collect()} == {"m/pom.xml", "m/src/target/B.java", "n/build/C.java"}


def test_diffs():
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n a\n@@ -9 +10,0 @@\ndiff --git a/o b/n\nrename from o\nrename to n\n"
    hunks, notes = files.parse_diff(text)
    assert [(h["target_path"], h["source_start"], h["source_len"], h["target_start"], h["target_len"]) for h in hunks] == [("x", 1, 2, 1, 3), ("x", 9, 1, 10, 0)]
    assert notes == ["renamed: o"]


def test_chunks():
    text = "".join(f"line {i}\n" for i in range(500))
    spans = files.spans(text, 1500, 350, 220)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b[0] < a[1] for a, b in zip(spans, spans[1:], strict=False))
    assert files.spans("", 10, 2, 1) == []


def test_build_and_increment(spark, tmp_path):
    root = tmp_path / "src" / "svc"
    (root / "p").mkdir(parents=True)
    (root / "pom.xml").write_text("<project/>")
    (root / "p" / "A.java").write_bytes(JAVA)
    store = Store(spark, str(tmp_path / "index"))
    mine = config.Overrides(roles_by_fqn={"p.Base": "SERVICE"}, capabilities_by_annotation={"Repository": ["STORES"]})
    assert build.full(spark, str(tmp_path / "src"), store, mine) == 1
    g = store.read()
    name = {r["id"]: r["fqn"] for r in g.symbol.select("id", "fqn").collect()}
    calls = {(name[r["src"]], name[r["dst"]]): r["strategy"] for r in g.edge("CALLS").collect()}
    assert calls[("p.A#get(Long)", "p.Repo#find(Long)")] == "import_map"
    assert calls[("p.A#go()", "p.A#helper(int,int)")] == "this_super"
    assert calls[("p.A#get(Long)", "p.A#conv(Object)")] == "method_reference"
    assert {(name[r["src"]], name[r["dst"]]) for r in g.edge("OVERRIDES").collect()} == {("p.A#go()", "p.Face#go()")}
    assert {r["reason"] for r in g.unresolved.collect()} >= {"chained_receiver"}
    roles = {r["fqn"]: (r["role"], r["microservice"]) for r in g.symbol.where("kind = 'class' and resolved").collect()}
    assert roles["p.A"] == ("CONTROLLER", "svc") and roles["p.Repo"] == ("REPOSITORY", "svc") and roles["p.Base"] == ("SERVICE", "svc")
    assert g.symbol.where("fqn = 'p.Repo'").first()["capabilities"] == ["STORES"]
    assert {r["match"] for r in g.edge("HTTP_CALLS").collect()} == {"phantom"}
    assert build.increment(spark, str(tmp_path / "src"), store) == (None, "none")
    (root / "p" / "New.java").write_text("package p; class New { void n(Repo r) { r.find(2L); } }")
    assert build.increment(spark, str(tmp_path / "src"), store, overrides=mine)[1] == "increment"
    one = store.read()
    build.full(spark, str(tmp_path / "src"), store, mine)
    two = store.read()
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(one.symbol) == rows(two.symbol)
    for k in one.edges:
        assert rows(one.edges[k]) == rows(two.edges[k]), k


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"ngram_q": 4, "candidate_count": 9, "hints": "off"}')
    s = config.settings({"ngram_q": 2}, tmp_path / "c.json", {"GRAFSPAN_CANDIDATE_COUNT": "x", "GRAFSPAN_HINTS": "no"})
    assert (s["ngram_q"].value, s["ngram_q"].source) == (2, "flag")
    assert (s["candidate_count"].value, s["candidate_count"].source) == (9, "file")
    assert (s["hints"].value, s["hints"].source, s["absent_floor"].source) == (False, "env", "default")
