"""What the grammars take and what they do not, beyond the fixtures of test_llm."""

import ast

import pytest

from quarry.llm import syntax

VALID = {
    "go": [
        'package a\nfunc f[T any](x T) T { return x }\n',
        'package a\nfunc f(y any) {\n\tswitch x := y.(type) {\n\tcase int:\n\t\treturn\n\tdefault:\n\t\tg(x)\n\t}\n}\n',
        'package a\ntype N interface {\n\t~int | ~string\n}\nvar m = M[string, int]{}\n',
    ],
    "ts": [
        'abstract class A { abstract f(): void }\n',
        'function f(this: Foo, a?: number): asserts a is number {}\n',
        'let x = y as const\n',
        'let a: A<B<C<D<E<F>>>>> = b\n',
        'const x = a as unknown as B\nconst y = 2\n',
        'declare const z: number\n',
    ],
    "js": [
        'class A { x = 1 }\n',
        'const a = b\n   / c / d\nconst r =            /x y/g\n',
        'for (const x of y) {}\nlet q = `a`\n',
        'x = `a${ f(1) }`\n',
    ],
    "py": [
        'type X = int\n',
        'f().x = 1\n(a, b) = c\n[d, *e] = g\nx[0] = y.z = 3\n',
        'def f(a, /, b=1, *, c, d=2, **e): pass\n',
        'def f(a, b: int = 1, *args: str, c=None, **kw) -> None: pass\n',
        'match type:\n    case None: pass\n    case A(x=1): pass\n',
        'from ... import x\nfrom .a import *\n',
        "x: int\ny: str = 'a'\n",
        'type(x)\nmatch = 1\nlambda a, /, b=1, *c: a\n',
        'if a:\n    if b:\n        c\n    else:\n        d\nelif e:\n    f\nelse:\n    g\ntry:\n    a\nexcept B:\n    c\nelse:\n    d\nfinally:\n    e\n',
    ],
    "sql": [
        "ALTER TABLE t ADD COLUMN c integer NOT NULL DEFAULT 0;\nCREATE UNIQUE INDEX IF NOT EXISTS i ON t (a, b);\nCREATE VIEW v AS SELECT 1;\nDROP TABLE IF EXISTS a, b CASCADE;\nGRANT SELECT, INSERT ON t TO r;\nEXPLAIN ANALYZE SELECT a FROM t;\nSET x = 1;\nCOMMENT ON TABLE t IS 'x';\nTRUNCATE t;\nPRAGMA foreign_keys = ON;\n",
        "INSERT INTO t (a) VALUES (1) ON CONFLICT (a) DO UPDATE SET a = 2 RETURNING a;\nUPDATE t SET a = 1, b = 'x' WHERE c > 2;\nDELETE FROM t WHERE a IN (SELECT b FROM c);\nWITH x AS (SELECT 1) SELECT * FROM x ORDER BY a DESC LIMIT 5 OFFSET 2;\nSTART TRANSACTION;\nROLLBACK;\n",
    ],
}
INVALID = {
    "sql": [
        'ALTER 1 2 3 + + ;',
        'CREATE INDEX ON ON + 5 , ,;',
        'GRANT ;',
        'EXPLAIN SELECT FROM WHERE',
        'COMMIT 1 2 3 a b',
    ],
    "py": [
        '1 = x\n',
        'f() = 1\n',
        'def f(a, a=1, b): pass\n',
        'None = 1\n',
        'if a:\n    b\n  c\n',
        'try:\n    a\nb\n',
        'if a:\n    b\nexcept C:\n    d\n',
        '@d\nx = 1\n',
    ],
    "js": [
        'const a;\n',
    ],
    "ts": [
        'const a: number;\n',
    ],
    "json": [
        '[1,]',
    ],
}


def test_constructs(spark):
    rows = [(f"{k}-{lang}-{i}", lang, t) for k, src in (("good", VALID), ("bad", INVALID)) for lang, ts in src.items() for i, t in enumerate(ts)]
    bad = {r.id for r in syntax.unparsable(spark.createDataFrame(rows, "id string, lang string, content string")).collect()}
    assert bad == {r[0] for r in rows if r[0].startswith("bad")}
    for t in VALID["py"]:
        ast.parse(t)
    for t in INVALID["py"]:
        with pytest.raises(SyntaxError):
            ast.parse(t)


def test_deep_nesting(spark):
    deep = "a" + "<b" * 40 + ">" * 40
    rows = [("types", "ts", f"let x: {deep} = y\n"), ("conditions", "js", "x = " + "a ? " * 20 + "b" + " : c" * 20 + "\n"), ("brackets", "py", "x = " + "[" * 200 + "]" * 200 + "\n"), ("open", "py", "x = " + "[" * 200 + "]" * 199 + "\n")]
    blocks = "".join("    " * i + "if a:\n" for i in range(60)) + "    " * 60 + "pass\nelse:\n    pass\n"
    rows += [("blocks", "py", blocks), ("dedent", "py", blocks.replace("else", "  else"))]
    bad = {r.id for r in syntax.unparsable(spark.createDataFrame(rows, "id string, lang string, content string")).collect()}
    assert bad == {"open", "dedent"}
