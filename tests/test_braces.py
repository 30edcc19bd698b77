"""Brace languages: symbols of small sources."""

JAVA = '''package a;
import java.util.*;
/** A shop. */
public class Shop extends Base {
    private static final int MAX = 3; // { no
    List<String> names = new ArrayList<>();
    public Shop(int n) { this.names = make(n); }
    /* sells */
    @Override
    public String sell(Map<String, Integer> x, int y) throws E {
        if (x != null) { call("}"); }
        return other(y);
    }
    interface Inner { void go(int a); }
    enum Kind { A, B }
}
'''
CPP = '''#include <x.h>
#define M(a) { a
struct point { int x; double *y; };
static int count = 0;
int proto(int a);
// adds
int add(int a, char *b)
{
    for (;;) { helper(a); }
    return a;
}
namespace q { class C { public: C(); ~C() { drop(); } void run(); }; }
void C::run() { go(); }
'''
KOTLIN = '''package z
data class P(val a: Int, val b: String)
class Box(val n: Int) : Base() {
    val size: Int = count(n)
    companion object { fun make(): Box = Box(1) }
    fun open(x: Int): String {
        return read(x)
    }
    constructor() : this(0) { init() }
}
fun top(a: Int) = helper(a)
'''
RUST = '''pub struct S { a: i32 }
impl S { pub fn new(a: i32) -> Self { make(a) } }
fn main() { S::new(1); println!("x"); }
'''


def _got(language, text):
    from tessera.sources.braces import brace_rows

    return {(r["kind"], r["fqdn"].removeprefix("d.f."), r["line_start"], r["line_end"]): r for r in brace_rows("d/f.x", language, text)}


def test_java():
    got = _got("java", JAVA)
    assert set(got) == {
        ("class", "Shop", 4, 16), ("field", "Shop.MAX", 5, 5), ("field", "Shop.names", 6, 6), ("constructor", "Shop.Shop", 7, 7), ("method", "Shop.sell", 9, 13),
        ("interface", "Shop.Inner", 14, 14), ("method", "Shop.Inner.go", 14, 14), ("enum", "Shop.Kind", 15, 15),
    }
    sell = got["method", "Shop.sell", 9, 13]
    assert (sell["callees"], sell["params"], sell["return_type"], sell["doc"]) == (["call", "other"], ["Map<String, Integer> x", "int y"], "String", "sells")


def test_cpp():
    got = _got("cpp", CPP)
    assert set(got) == {
        ("struct", "point", 3, 3), ("field", "point.x", 3, 3), ("field", "point.y", 3, 3), ("variable", "count", 4, 4), ("function", "add", 7, 11),
        ("namespace", "q", 12, 12), ("class", "q.C", 12, 12), ("destructor", "q.C.~C", 12, 12), ("method", "run", 13, 13),
    }
    assert got["function", "add", 7, 11]["doc"] == "adds" and got["destructor", "q.C.~C", 12, 12]["callees"] == ["drop"]


def test_kotlin_and_rust():
    got = _got("kotlin", KOTLIN)
    assert set(got) == {
        ("class", "P", 2, 2), ("class", "Box", 3, 10), ("field", "Box.size", 4, 4), ("object", "Box.Companion", 5, 5), ("method", "Box.Companion.make", 5, 5),
        ("method", "Box.open", 6, 8), ("constructor", "Box.Box", 9, 9), ("function", "top", 11, 11),
    }
    assert got["method", "Box.open", 6, 8]["return_type"] == "String" and got["function", "top", 11, 11]["callees"] == ["helper"]
    assert set(_got("rust", RUST)) == {("struct", "S", 1, 1), ("impl", "S", 2, 2), ("method", "S.new", 2, 2), ("function", "main", 3, 3)}
    assert not _got("java", None) and not _got("c", "}}} ;;; {{{ (((")


def test_registry_parses_all(spark):
    from tessera.sources.adapters import default_registry

    files = spark.createDataFrame([("a.java", "java", JAVA), ("b.kt", "kotlin", KOTLIN), ("c.py", "python", "def f(): pass"), ("d.txt", None, "x")], "rel_path string, language string, content string")
    ids = {r.unique_id for r in default_registry().parse(files).collect()}
    assert {"a.java::fn.Shop.sell", "b.kt::fn.top", "c.py::fn.f"} <= ids and not any(i.startswith("d.txt") for i in ids)
