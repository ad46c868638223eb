"""Lexers and grammars for p4: token classes, permissible pairs derived from productions, and the productions themselves.

Each class of tokens is one character, so the tokens of a bracket group are a string and a production is a regular
expression over it. Inner groups stand as their two brackets, which makes the grammar of a group regular.
"""

from __future__ import annotations

import re
from itertools import product

try:
    from re import _constants as op
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as op
    import sre_parse as parser

EXTENSIONS = {"py": "py", "js": "js", "ts": "ts", "go": "go", "json": "json", "toml": "toml", "sql": "sql"}

_DQ, _SQ = r'"(?:[^"\\\r\n]++|\\[\s\S])*+"', r"'(?:[^'\\\r\n]++|\\[\s\S])*+'"
_NL = r"(?:\r\n?|\n)[ \t\f]*"
_WORD = r"[\p{L}_$][\p{L}\p{M}\p{N}_$]*+"
_NUM = r"(?:0[xX][0-9a-fA-F_]++|0[oO][0-7_]++|0[bB][01_]++|(?:\d[\d_]*+(?:\.(?!\.)[\d_]*+)?+|\.\d[\d_]*+)(?:[eE][+-]?+\d++)?+)[jnimu]?+(?![\p{L}\p{N}_])"
_C = r"//[^\r\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"
#: A regular expression literal, with the blanks before it: \G is where the token before ended, so what that was decides.
_JS_RE = r"(?:(?:(?<=[=(,:\[!&|?{;+*%<>~^-])|\A)\G\s*+|(?:(?<=\})|(?<=\breturn)|(?<=\bcase)|(?<=\btypeof))\G[ \t\f]*+)/(?![*/])(?:[^/\\\[\r\n]++|\\[^\r\n]|\[(?:[^\]\\\r\n]++|\\[^\r\n])*+\])++/[a-z]*+"
_TPL = r"`(?:[^`\\$]++|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]++|\{[^{}]*+\}|`[^`]*+`)*+\})*+`"

#: The tokens of each language, longest first; blanks match nothing and are skipped, any other character is a token.
LEXERS = {
    "py": rf"#[^\r\n]*+|\\(?:\r\n?|\n)|{_NL}|(?:[rRbBfFuU]{{0,2}}(?:\"\"\"(?:[^\"\\]++|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''|{_DQ}|{_SQ}))"
    rf"|{_NUM}|{_WORD}|\.\.\.|\*\*=|//=|>>=|<<=|->|:=|\*\*|//|<<|>>|[-+*/%@&|^<>=!]=|[^ \t\f\x{{FEFF}}]",
    "js": rf"{_JS_RE}|{_C}|{_NL}|{_DQ}|{_SQ}|{_TPL}|{_NUM}|#?{_WORD}|\.\.\.|>>>=|\*\*=|<<=|>>=|>>>|===|!==|&&=|\|\|=|\?\?=|=>|\?\.(?!\d)|\?\?|\*\*|\+\+|--|<<|>>|&&|\|\||[-+*/%&|^<>=!]=|[^ \t\f\x{{FEFF}}\x{{A0}}]",
    "ts": rf"{_JS_RE}|{_C}|{_NL}|{_DQ}|{_SQ}|{_TPL}|{_NUM}|#?{_WORD}|\.\.\.|\*\*=|<<=|===|!==|&&=|\|\|=|\?\?=|=>|\?\.(?!\d)|\?\?|\*\*|\+\+|--|<<|&&|\|\||[-+*/%&|^<=!]=|[^ \t\f\x{{FEFF}}\x{{A0}}]",
    "go": rf"{_C}|{_NL}|{_DQ}|`[^`]*+`|{_SQ}|{_NUM}|{_WORD}|\.\.\.|<<=|>>=|&\^=|:=|<-|\+\+|--|<<|>>|&\^|&&|\|\||[-+*/%&|^<>=!]=|[^ \t\f\x{{FEFF}}]",
    "json": r'"(?:[^"\\\x00-\x1F]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|-?(?:0|[1-9]\d*+)(?:\.\d++)?+(?:[eE][+-]?+\d++)?+(?![\w.])|[A-Za-z_]\w*+|[^ \t\r\n]',
    "toml": rf"#[^\r\n]*+|{_NL}|\"\"\"(?:[^\"\\]++|\\[\s\S]|\"(?!\"\"))*+\"{{3,5}}|'''(?:[^']|'(?!''))*+'{{3,5}}|{_DQ}|'[^'\r\n]*+'|[A-Za-z0-9_+-][A-Za-z0-9_+:.-]*+|[^ \t]",
    "sql": r"--[^\r\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/|'(?:[^']|'')*+'|\"(?:[^\"]|\"\")*+\"|`[^`]*+`|(?:\d++(?:\.\d*+)?+|\.\d++)(?:[eE][+-]?+\d++)?+(?![\p{L}_])"
    r"|[\p{L}_][\p{L}\p{N}_$]*+|::|<>|<=|>=|!=|\|\||->>?|[^ \t\r\n\f\x{FEFF}]",
}

#: What words and signs of a language are; class: tokens. Other words are names n, numbers 0, strings s; unknown signs are errors.
_OPS = {"(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}", ",": ",", ":": ":", ".": ".", ";": ";", "=": "="}
CLASSES = {
    "py": _OPS
    | {
        "j": "None True False ...", "J": "type", "D": "def", "C": "class", "R": "return", "I": "if", "L": "elif", "E": "else", "F": "for", "W": "while", "i": "in", "A": "async", "a": "await", "T": "try",
        "X": "except", "Y": "finally", "w": "with", "M": "import", "m": "from", "S": "as", "P": "pass break continue", "Q": "raise", "y": "yield", "l": "lambda", "g": "global nonlocal", "d": "del",
        "t": "assert", "u": "not ~", "z": "is", "h": "match case", "o": "/ // % & | ^ << >> < > <= >= == != and or", "*": "* **", "-": "- +", "@": "@", "q": "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=",
        "~": ":=", ">": "->",
    },
    "js": _OPS
    | {
        "n": "this super null true false undefined as from of get set static", "V": "var let", "k": "const", "F": "function", "C": "class", "X": "extends", "A": "async", "W": "await", "Y": "yield", "N": "new",
        "u": "! ~ typeof void delete", "R": "return throw", "I": "if while with", "E": "else", "O": "for", "D": "do", "T": "try", "K": "catch", "Z": "finally", "S": "switch", "c": "case", "d": "default",
        "B": "break continue debugger", "M": "import", "P": "export", "o": "/ % ** == === != !== < > <= >= && || ?? & | ^ << >> >>> instanceof in", "*": "*", "-": "- +", "i": "++ --",
        "q": "+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=", ">": "=>", ".": ". ?.", "?": "?", "e": "...",
    },
    "go": _OPS
    | {
        "P": "package", "M": "import", "F": "func", "Y": "type", "V": "var const", "S": "struct", "J": "interface", "p": "map", "c": "chan", "I": "if", "E": "else", "O": "for", "r": "range",
        "W": "switch select", "C": "case", "D": "default", "R": "return", "G": "go defer", "B": "break continue fallthrough goto", "~": ":=", "q": "+= -= *= /= %= &= |= ^= <<= >>= &^=", "k": "++ --",
        "o": "/ % | << >> &^ == != < <= > >= && ||", "*": "*", "-": "- + & ^", "u": "! ~", "x": "<-", "e": "...",
    },
    "json": {"{": "{", "}": "}", "[": "[", "]": "]", ",": ",", ":": ":", "v": "true false null"},
    "toml": {"{": "{", "}": "}", "[": "[", "]": "]", ",": ",", "=": "=", ".": "."},
    "sql": _OPS
    | {
        "S": "SELECT", "F": "FROM", "W": "WHERE", "G": "GROUP ORDER PARTITION", "B": "BY", "H": "HAVING", "J": "JOIN", "K": "INNER LEFT RIGHT FULL CROSS NATURAL OUTER", "O": "ON", "U": "USING",
        "a": "AS", "i": "INSERT REPLACE", "I": "INTO", "V": "VALUES", "C": "CREATE", "T": "TABLE", "b": "BEGIN COMMIT ROLLBACK END START", "D": "DISTINCT ALL", "L": "LIMIT OFFSET FETCH", "M": "UNION INTERSECT EXCEPT",
        "w": "WITH", "E": "UPDATE", "e": "SET", "d": "DELETE", "A": "ALTER", "R": "DROP TRUNCATE", "g": "GRANT REVOKE", "y": "ANALYZE VACUUM", "X": "EXPLAIN", "P": "PRAGMA USE SHOW", "m": "COMMENT", "Y": "COPY CALL",
        "Q": "INDEX", "q": "VIEW", "u": "NOT", "o": "AND OR + / % < > <= >= <> != || LIKE ILIKE BETWEEN IN IS",
        "-": "-", "*": "*", "t": "::", "x": "EXISTS", "c": "CASE", "h": "WHEN THEN ELSE", "z": "ASC DESC NULLS FIRST LAST", "k": "PRIMARY FOREIGN UNIQUE CHECK CONSTRAINT REFERENCES KEY DEFAULT", "v": "OVER FILTER",
    },
}
CLASSES["ts"] = {**CLASSES["js"], "o": "/ % ** == === != !== <= && || ?? & | ^ << instanceof in keyof is readonly infer", "<": "<", "G": ">", "J": "interface enum namespace module", "y": "type", "n": CLASSES["js"]["n"] + " abstract declare public private protected"}

_TOML_VALUE = (
    r"[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|[+-]?(?:inf|nan)|true|false"
    r"|\d{4}-\d\d-\d\d(?:[Tt]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?"
)
TOML_VALUE, TOML_KEY = rf"\A(?:{_TOML_VALUE})\z", r"\A[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\z"


def _python() -> dict[str, str]:
    name = r"[nhJ]"
    group = r"\(\)|\[\]|\{\}"
    lam = rf"l(?:[nhJj,*=0s.\-o]|{group})*+:"
    unary = rf"(?:[u\-a*]|{lam})*+"
    operand = rf"(?:[nhJj0]|s++|{group})(?:\.{name}|\(\)|\[\])*+"
    chain = rf"{unary}{operand}(?:(?:[o\-*@~]|u?+i|zu?+){unary}{operand})*+"
    expr = chain  # conditions are taken out of the strings beforehand (REDUCED)
    some = rf"{expr}(?:,{expr})*+,?+"
    called = r"\(\)(?=[.(\[])"  # a call is no target itself
    one = rf"\*?+(?:{name}(?:\.{name}|\[\]|{called})*+|(?:\(\)|\[\])(?![.(\[])|(?:[j0]|s++|{group})(?:\.{name}|\[\]|{called})++)"
    target = rf"{one}(?:,{one})*+,?+"
    comp = rf"(?:A?+F{target}i{chain}(?:I{chain})*+)*+"
    give = rf"y(?:m?+{some})?+"
    arg = rf"(?:\*?+n:{expr}(?:={expr})?+|{name}={expr}|{give}|{expr}(?:S{operand})?+{comp}|[*o])"
    sub = rf"(?:{expr}{comp})?+(?::(?:{expr})?+)*+"
    item = rf"{expr}(?::{expr})?+{comp}"
    dotted = rf"{name}(?:\.{name})*+"
    names = rf"{name}(?:S{name})?+(?:,{name}(?:S{name})?+)*+"
    assigned = rf"(?:{target}=)++(?:{give}|{some})|{one}q(?:{give}|{some})|{one}:{expr}(?:=(?:{give}|{some}))?+"
    simple = (
        rf"(?:P|R(?:{some})?+|Q(?:{expr}(?:m{expr})?+)?+|M{dotted}(?:S{name})?+(?:,{dotted}(?:S{name})?+)*+|m[.nhJj]*+M(?:\*|\(\)|{names})|g{name}(?:,{name})*+|d{some}|t{expr}(?:,{expr})?+|{give}"
        rf"|J{name}(?:\[\])?+={expr}|{assigned}|{some})"
    )
    simples = rf"{simple}(?:;{simple})*+;?+"
    withs = rf"{expr}(?:S{operand})?+"
    head = (
        rf"(?:A?+D{name}(?:\[\])?+\(\)(?:>{expr})?+|C{name}(?:\[\])?+(?:\(\))?+|[ILW]{expr}|E|T|Y|A?+F{target}i{some}|A?+w{withs}(?:,{withs})*+,?+|X\*?+(?:{some}(?:S{name})?+)?+|h{some}(?:S{name})?+(?:I{expr})?+)"
    )
    # parameters of a function: those with a value come last, but for those behind a star
    typed, end = rf"{name}(?::{expr})?+", r"(?:,|(?=\)))"
    plain, filled, star = rf"{typed}(?!=)", rf"{typed}={expr}", rf"\*(?:{name}(?::{expr})?+)?+"
    params = rf"(?:(?:{plain}|o){end})*+(?:(?:{filled}|o){end})*+(?:{star}{end}(?:(?:{filled}|{plain}|{star}){end})*+)?+"
    return {
        "REDUCED": rf"I{chain}E",
        "JOINED": rf"{chain}I{chain}E{chain}",
        "top": rf"N(?:@{expr}|{head}:(?:{simples})?+|{simples})?+",
        "(": rf"\((?:{arg}(?:,{arg})*+,?+)?+\)",
        "p": rf"p{params}\)",
        "[": rf"\[(?:{sub}(?:,{sub})*+)?+\]",
        "{": rf"\{{(?:{item}(?:,{item})*+,?+)?+\}}",
    }


#: Classes that begin a statement wherever they begin a line, in JavaScript and TypeScript.
STARTERS = "VkIODTSRBMPcdW"
#: Type arguments of TypeScript, innermost first; they are taken out of the strings.
TYPE_ARGUMENTS = r"<(?:[nsu0NyJ.oX|,=>:?\-eFk]|\(\)|\[\]|\{\})*+G"


def _script(typed: bool) -> dict[str, str]:
    word = "[nVkFCXAWYNuRIEODTKZSBcdMPJy]" if typed else "[nVkFCXAWYNuRIEODTKZSBcdMP]"
    if typed:
        # type arguments are taken out of the strings beforehand (TYPE_ARGUMENTS); a type is names, literals and groups, joined by | & and the like
        unit = r"(?:u(?![ny])|(?:[uo])*+(?:[nsy0](?:\.n)*+|\(\)>?+|\{\}|\[\]|N\(\)>?+|F))(?:\[\])*+"
        typ = rf"o?+{unit}(?:[o?:X]{unit}|(?<=>){unit})*+"
        of, opt = rf"(?:\??+:(?:n(?=no?))?+{typ}|\?)?+", ""  # asserts x is T
        cast = rf"(?:n(?:{typ}|k))*+"  # as, satisfies
    else:
        of = opt = cast = ""
    fn = rf"F\*?+n?+{opt}\(\){of}\{{\}}"
    cls = rf"Cn?+{opt}(?:X[n]{opt}(?:\.n|\(\))*+)?+" + (rf"(?:nn{opt}(?:,n{opt})*+)?+" if typed else "") + r"\{\}"
    arrow = rf"A?+(?:n|{opt}\(\){of})>"
    unary = rf"(?:[u\-iNWeA]|Y\*?+|{arrow})*+" if not typed else rf"(?:[u\-iNWeA]|Y\*?+|{arrow})*+"
    operand = rf"(?:A?+{fn}|{cls}|[ns0M]|\(\)|\[\]|\{{\}}" + (r"|[yJ]" if typed else "") + rf")(?:\.(?:{word}|\(\)|\[\])|\(\)|\[\]|s|i" + (r"|u(?=[.;,)\]}oq=?:$])" if typed else "") + r")*+" + cast
    part = rf"{unary}{operand}"
    binary = r"[o*\-q=<G]" if typed else r"[o*\-q=]"
    chain = rf"{part}(?:{binary}{part})*+"
    expr = chain  # conditions are taken out of the strings beforehand (REDUCED)
    some = rf"{expr}(?:,{expr})*+"
    bind = rf"(?:n|\[\]|\{{\}}){'u?+' if typed else ''}{of}(?:={expr})?+"
    key = rf"(?:{word}|[s0]|\[\])"
    given = rf"(?:n|\[\]|\{{\}}){of}={expr}"  # constants have a value, but for ambient ones of TypeScript
    body = rf"{opt}\(\){of}\{{\}}"
    mods = r"(?:[nA*](?=[^(:=,};<?]))*+"
    member = rf"(?:{mods}{key}{body}|{key}:{expr}|n={expr}|e{expr}|n)"
    obj = rf"(?:{member}(?:,{member})*+,?+)?+"
    end = r"(?:;|(?=\}))"
    field = rf"(?:;|{mods}{key}(?:{body}|{'u?+' if typed else ''}{of}(?:={expr})?+{end})|n\{{\}}" + (rf"|{mods}{key}{opt}\(\){of}{end}" if typed else "") + r")*+"
    alias = rf"(?:[nd](?:n[nd])?+(?:,[nd](?:n[nd])?+)*+,?+)?+"
    sig = rf"(?:(?:n(?=[n\[s]))?+(?:{key}(?:o(?=[nsuy0({{\[F]){typ}|\??+(?:{opt}\(\))?+{of})|{opt}\(\){of})(?:={expr})?+[;,]?+)*+" if typed else ""
    param = rf"(?:e?+(?:n(?=n))?+{bind})"
    close = r"(?:;|(?=[}$])|(?<=\}))"
    ambient = rf"|nk{bind}(?:,{bind})*+" if typed else ""
    simple = rf"(?:V{bind}(?:,{bind})*+|k{given}(?:,{given})*+{ambient}|R(?:{some})?+|Bn?+|{some})"
    types = rf"|P?+n?+yn{opt}={typ}{close}|P?+d?+n?+[Vk]?+J[ns]{opt}(?:X[n]{opt}(?:,n{opt})*+)?+\{{\}}" if typed else ""
    source = r"ns(?:n\{\})?+"
    stmt = (
        rf"(?:;|\{{\}}|A?+F\*?+n{opt}\(\){of}(?:\{{\}}{'|;' if typed else ''})|{'n?+' if typed else ''}{cls}|I\(\)(?!;(?=[}}$]))|E|OW?+\(\)|D|T\{{\}}|K(?:\(\))?+\{{\}}|Z\{{\}}|S\(\)\{{\}}|c{expr}:|d:|n:(?=[OID{{])"
        rf"|M(?:s|(?:y(?=[{{n]))?+(?:n,)?+(?:n|\*nn|\{{\}}){source}){close}|P(?:\*(?:nn)?+{source}{close}|(?:y(?=\{{))?+\{{\}}(?:{source})?+{close}|d(?:A?+F\*?+n?+{opt}\(\){of}\{{\}}|{cls}|{expr}{close})|(?=[AFVkCJyn]))"
        rf"{types}|{simple}{close})*+"
    ).replace("|M(?:s|(?:y(?=[{n]))?+", "|M(?:s|(?:y(?=[{n]))?+" if typed else "|M(?:s|")
    case = stmt
    brace = rf"(?:{stmt}|{obj}|{field}|{alias}" + (f"|{sig}" if typed else "") + ")"
    tuple_ = r"|(?:e?+n\??+:)?+" if typed else ""
    return {
        "REDUCED": rf"\?{chain}:",
        "JOINED": rf"{chain}\?{chain}:{chain}",
        "top": rf"\^{stmt}\$",
        "(": rf"\((?:(?:[Vk](?:n|\[\]|\{{\}})[no]{expr}|[Vk]{bind}|{expr})?+(?:;(?:{some})?+;(?:{some})?+)?+|[Vk]{bind}(?:,{bind})*+;(?:{some})?+;(?:{some})?+|{expr}(?:,{expr})*+,?+|{param}(?:,{param})*+,?+"
        + (rf"|{typ}" if typed else "")
        + r")\)",
        "[": rf"\[(?:,|{expr}(?:,|(?=\])))*+\]" if not typed else rf"\[(?:,|(?:{expr}|{typ}|n:{typ})(?:,|(?=\])))*+\]",
        "{": rf"\{{{brace}\}}",
        "b": rf"b{case}\}}",
    }


def _go() -> dict[str, str]:
    typ = r"(?:\*|c|x|e|\[\]|p\[\])*+(?:n(?:\.n)?+(?:\[\])?+|S\{\}|J\{\}|F\(\)(?:\(\)|\*?+n(?:\.n)?+)?+|\(\))"
    fn = rf"F\(\)(?:{typ})?+\{{\}}"
    lit = r"(?:(?:\[\]|p\[\])++\*?+(?:n(?:\.n)?+|S\{\}|J\{\})|S\{\})"
    unary = r"[u\-*x]*+"
    operand = rf"(?:{fn}|{lit}(?:\{{\}}|\(\))?+|n|0|s|\(\)|\{{\}}|c{typ}|F\(\)(?:{typ})?+|J\{{\}})(?:\.(?:n|\(\))|\(\)|\[\]|\{{\}})*+"
    chain = rf"{unary}{operand}(?:[o*\-]{unary}{operand})*+"
    expr = rf"{chain}e?+"
    bare = rf"{unary}(?:{fn}|n|0|s|\(\)|\[\]n)(?:\.(?:n|\(\))|\(\)|\[\])*+"  # in headers, where a brace begins the block
    test = rf"{bare}(?:[o*\-]{bare})*+"
    first = rf"(?:{test}(?:,{test})*+(?:(?:[=~q]|x)(?:r{test}|{test}(?:,{test})*+)|k)?+|r{test})"
    some = rf"(?:{expr}|{typ})(?:,(?:{expr}|{typ}))*+,?+"
    names = r"n(?:,n)*+"
    simple = rf"(?:{expr}(?:,{expr})*+(?:(?:[=~q]|x)(?:r{expr}|{expr}(?:,{expr})*+)|k)?+|r{expr})"
    decl = rf"{names}(?:{typ})?+(?:=(?:{expr})(?:,{expr})*+)?+"
    field = rf"(?:n(?:,n)*+{typ}|\*?+n(?:\.n)?+)s?+;"
    union = rf"u?+{typ}(?:ou?+{typ})*+"  # of types, in constraints
    sig = rf"(?:n\(\)(?:{typ})?+|{union});"
    end = r"(?:;|(?=[}$]))"
    stmt = (
        rf"(?:;|F(?:\(\))?+n(?:\[\])?+\(\)(?:{typ})?+(?:\{{\}})?+{end}|Yn(?:\[\])?+=?+{typ}{end}|Y\(\){end}|V(?:\(\)|{decl}){end}|R(?:{expr}(?:,{expr})*+)?+{end}|Bn?+{end}|G{expr}{end}|n:(?=[^=])"
        rf"|I(?:{first};)?+{test}\{{\}}(?:EI(?:{first};)?+{test}\{{\}})*+(?:E\{{\}})?+{end}|O(?:(?:{first})?+;(?:{test})?+;(?:{first})?+|{first})?+\{{\}}{end}|W(?:{first};)?+(?:{first})?+\{{\}}{end}"
        rf"|C(?:{simple}|{some}):|D:|\{{\}}{end}|{simple}{end})*+"
    )
    item = rf"(?:(?:{expr}):(?:{expr})|{expr})"
    param = rf"(?:n(?:,n)*+)?+e?+{typ}"
    return {
        "top": rf"\^;*+Pn;(?:;|M(?:n|\.)?+s;|M\(\);)*+{stmt}\$",
        "(": rf"\((?:Y|(?:(?:n|\.)?+s;?+|;)*+|(?:{decl};?+)*+|(?:n=?+{typ};?+)*+|{some}|(?:(?:n\s?+)?+e?+{typ}|n)(?:,(?:ne?+{typ}|e?+{typ}|n))*+,?+)\)",
        "[": rf"\[(?:(?:{expr}|{typ}|e)?+(?::(?:{expr})?+)*+|{typ}(?:,{typ})++,?+|n(?:,n)*+{union}(?:,n(?:,n)*+{union})*+,?+)\]",
        "{": rf"\{{(?:{stmt}|(?:{item}(?:,{item})*+,?+)?+|(?:{field})*+|(?:{sig})*+)\}}",
    }


def _json() -> dict[str, str]:
    value = r"(?:[s0v]|\{\}|\[\])"
    return {"top": rf"\^{value}\$", "{": rf"\{{(?:s:{value}(?:,s:{value})*+)?+\}}", "[": rf"\[(?:{value}(?:,{value})*+)?+\]"}


def _toml() -> dict[str, str]:
    key = r"[nvs](?:\.[nvs])*+"
    value = r"(?:[vs]|\{\}|\[\])"
    return {
        "top": rf"\^(?:N|(?:{key}={value}|\[\])(?:N|(?=\$)))*+\$",
        "[": rf"\[N*+(?:{value}N*+(?:,N*+{value}N*+)*+(?:,N*+)?+)?+\]",
        "H": rf"H(?:{key}|\[\])\]",  # a table's name
        "K": rf"K{key}\]",
        "{": rf"\{{(?:{key}={value}(?:,{key}={value})*+)?+\}}",
    }


def _sql() -> dict[str, str]:
    word = r"[nQq]"  # INDEX and VIEW may be names
    name = rf"{word}(?:\.(?:{word}|\*))*+"
    operand = rf"(?:{name}(?:\(\))?+(?:v(?:n|\(\)))*+|[0s*D]|\(\)|x\(\)|V\(\)|c(?:n|[0s]|\(\)|[ho\-*=]|\.)*+b|k(?:\(\))?+|K\(\))(?:tn(?:\(\))?+|\[\]|n\(\))*+"
    unary = r"[u\-]*+"
    chain = rf"{unary}{operand}(?:(?:u?+o|[*\-=])(?:[Du]|o)*+{unary}{operand})*+"
    item = rf"(?:D(?!$))?+{chain}(?:a?+(?:{word}|s))?+"
    items = rf"{item}(?:,{item})*+"
    source = rf"(?:{name}(?:\(\))?+|\(\))(?:a?+{word}(?:\(\))?+)?+"
    joins = rf"(?:,{source}|K*+J{source}(?:O{chain}|U\(\))?+)*+"
    order = rf"{chain}z*+(?:,{chain}z*+)*+"
    select = rf"SD?+(?:O\(\))?+(?:{items})(?:F{source}{joins})?+(?:W{chain})?+(?:GB{order})?+(?:H{chain})?+(?:GB{order})?+(?:L(?:n|z)?+(?:{chain})?+n*+)*+"
    query = rf"(?:{select}|\(\)|V\(\)(?:,\(\))*+)(?:MD?+(?:{select}|\(\)|V\(\)))*+(?:GB{order})?+(?:L{chain})*+"
    cte = rf"w(?:n(?=n))?+{word}(?:\(\))?+a(?:n\s?+)?+\(\)(?:,{word}(?:\(\))?+a\(\))*+"
    sets = rf"e(?:{name}|\(\))={chain}(?:,(?:{name}|\(\))={chain})*+"
    back = rf"(?:n{items})?+"  # returning
    conflict = rf"(?:On(?:\(\)|On{word})?+(?:W{chain})?+n(?:n|E{sets}(?:W{chain})?+)|OnkE{name}={chain}(?:,{name}={chain})*+)?+"
    insert = rf"i(?:oi)?+I{name}(?:\(\))?+(?:{query}|kV){conflict}{back}"
    update = rf"E{source}{sets}(?:F{source}{joins})?+(?:W{chain})?+{back}"
    delete = rf"dF{source}(?:U{source}{joins})?+(?:W{chain})?+{back}"
    exists = r"(?:n?+u?+x)?+"  # if (not) exists
    some = rf"{name}(?:,{name})*+"
    clause = rf"(?:{word}|[kTuoas0=*aDFUzO]|\-0|\(\)|\.{word}|t{word})"
    table = rf"n*+T{exists}{name}(?:\(\)(?:n|w\(\))*+|a(?:{cte})?+{query}|\(\)a{query})"
    index = rf"(?:k|n)?+Q(?:n(?=[nQq]O))?+{exists}(?:{name})?+O{name}(?:U{word})?+\(\)(?:W{chain})?+"
    view = rf"n*+q{exists}{name}(?:\(\))?+a(?:{cte})?+{query}"
    other = rf"n{{1,3}}{exists}(?:{name})?+{clause}*+"
    actions = rf"(?:[nRAek]|\.)(?:{clause}|[eRQ])*+"
    alter = rf"A(?:T|Q|q|n){exists}{name}{actions}(?:,{actions})*+"
    drop = rf"R(?:(?:T|Q|q|n(?=[nx])){exists})?+{some}(?:O{name})?+n*+"
    grant = rf"g(?:[nSiEdDkC]++(?:\(\))?+)(?:,[nSiEdkC]++(?:\(\))?+)*+(?:O(?:T|Q|q|n(?=n(?:\.n)*+[nF]n))?+{some}(?:\(\))?+)?+[nF]{word}(?:,{word})*+(?:w[no]*+)?+"
    comment = rf"mO(?:T|Q|q|n){name}o(?:s|n)"
    copy = rf"Y(?:T?+{name}(?:\(\))?+|\(\))(?:[Fn](?:s|n)(?:w?+(?:\(\)|n|s)*+))?+"
    said = rf"(?:P(?:{name}|{clause})*+(?:=(?:{word}|s|\-?0))?+|y(?:y|n)*+(?:T?+{name}(?:\(\))?+)?+|e(?:{name})(?:[=n](?:{clause}(?:,{clause})*+)|{clause}*+)|bn*+)"
    run = rf"(?:(?:{cte})?+(?:{query}|{insert}|{update}|{delete}))"
    stmt = rf"(?:C(?:oi)?+(?:{table}|{index}|{view}|{other})|{run}|X(?:y|n)*+(?:\(\))?+{run}|{alter}|{drop}|{grant}|{comment}|{copy}|{said})"
    column = rf"(?:{word}(?:{word}|\.)*+(?:\(\))?+n*+(?:k+(?:\(\))?+|u(?:n|o)|n(?:\.n)*+(?:\(\))?+|0|s|\-0|O[dEn]\w*+|e)*+|k++(?:n)?+(?:k*+\(\)(?:k{name}(?:\(\))?+(?:O[dE][ne]?+\w*+)*+)?+)++)"
    return {
        "top": rf"\^(?:;|{stmt}(?:;|(?=\$)))*+\$",
        "(": rf"\((?:(?:{cte})?+{query}|{column}(?:,{column})*+|(?:{items})?+(?:F{chain})?+(?:GB{order})*+(?:a{name}(?:\(\))?+)?+|{order})\)",
        "[": rf"\[(?:{items})?+\]",
    }


PRODUCTIONS = {"py": _python(), "js": _script(False), "ts": _script(True), "go": _go(), "json": _json(), "toml": _toml(), "sql": _sql()}
#: Conditions, innermost first, and what they stand as in a file's string: an operator between the value before and the one after.
REDUCED = {lang: ps.pop("REDUCED") for lang, ps in PRODUCTIONS.items() if "REDUCED" in ps}
JOINED = {lang: ps.pop("JOINED") for lang, ps in PRODUCTIONS.items() if "JOINED" in ps}


def pairs(pattern: str) -> set[tuple[str, str]]:
    """Neighbouring characters in the strings that a pattern matches, from the first and last sets of its parts."""
    out: set[tuple[str, str]] = set()
    everything = {chr(c) for c in range(33, 127)}

    def walk(node) -> tuple[bool, set, set]:  # may be empty, first, last
        empty, first, last = True, set(), set()
        for kind, arg in node:
            if kind in (op.ASSERT_NOT, op.AT):
                continue
            if kind is op.ASSERT and arg[0] < 0:  # only what is said here comes before
                last, empty = walk(arg[1])[2], False
                continue
            if kind is op.ASSERT:  # what must follow is all that may follow
                _, f, _ = walk(arg[1])
                out.update(product(last, f))
                first |= f if empty else set()
                empty, last = False, set()
                continue
            if kind is op.LITERAL:
                e, f, z = False, {chr(arg)}, {chr(arg)}
            elif kind in (op.IN, op.NOT_LITERAL, op.ANY):
                chars = set()
                for k, v in arg if kind is op.IN else []:
                    if k is op.LITERAL:
                        chars.add(chr(v))
                    elif k is op.RANGE:
                        chars |= {chr(c) for c in range(v[0], v[1] + 1)}
                    elif k is op.CATEGORY and v is op.CATEGORY_WORD:
                        chars |= {c for c in everything if c.isalnum()}
                if kind is not op.IN:
                    chars = everything - {"!"}
                elif arg and arg[0][0] is op.NEGATE:
                    chars = everything - chars - {"!"}
                e, f, z = False, chars, chars
            elif kind is op.SUBPATTERN:
                e, f, z = walk(arg[-1])
            elif kind is op.BRANCH:
                parts = [walk(x) for x in arg[1]]
                e, f, z = any(p[0] for p in parts), set().union(*[p[1] for p in parts]), set().union(*[p[2] for p in parts])
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
                low, high, sub = arg
                e, f, z = walk(sub)
                if high > 1:
                    out.update(product(z, f))
                e = e or low == 0
            elif kind is op.ATOMIC_GROUP:
                e, f, z = walk(arg)
            else:
                raise ValueError(kind)
            out.update(product(last, f))
            first |= f if empty else set()
            last = z | last if e else z
            empty = empty and e
        return empty, first, last

    walk(parser.parse(pattern))
    return out


#: What a group's bracket, or a Python line, is written as where the group begins in a file's string of classes.
PLAIN = {"py": {"p": "("}, "js": {"b": "{"}, "ts": {"b": "{"}, "toml": {"H": "[", "K": "["}}


def mark(kind: str) -> str:
    """The character that begins a group of the kind."""
    return chr(128 + ord(kind))


LINE = mark("N")
#: A file's string up to its first bracket group.
LINES = f"\\A[^\x80-{chr(ord(LINE) - 1)}{chr(ord(LINE) + 1)}-\xff]*+"


def file_pattern(language: str) -> str:
    """What a file's string of classes must match: its statements, then group after group, each by the production of its kind."""
    rest = lambda kind: PRODUCTIONS[language][kind].removeprefix("\\").removeprefix(kind)
    top = PRODUCTIONS[language]["top"]
    if language == "py":
        top = f"(?:{LINE}{top.removeprefix('N')})*+"
    groups = [mark(k) + rest(k) for k in PRODUCTIONS[language] if k not in ("top", "K")]
    if language == "toml":  # [[ is a table's name or an array in an array
        groups.append(f"{mark('?')}(?:{rest('K')}|{rest('[')})")
    return f"\\A{top}(?:{'|'.join(groups)})*+\\z"


def permissible(language: str) -> set[tuple[str, str]]:
    """Pairs of classes that may follow each other in the text: those of all productions, with the marks of group kinds undone."""
    plain = PLAIN.get(language, {})
    found: set[tuple[str, str]] = set()
    for kind, p in [*PRODUCTIONS[language].items(), ("", JOINED.get(language, ""))]:
        for a, b in pairs(p):
            # a kind's mark is only where its group begins
            found.add((plain[a] if kind in plain and a == kind else a, b))
    if language == "ts":
        after = {b for a, b in found if a in "n]"}
        found |= {("n", "<")} | {("G", b) for b in after | set("({=;,>[G.")} | pairs(r"<(?:[nsu0NyJ.oX|,=>:?\-eFk<]|\(|\)|\[|\]|\{|\}|G)*G") | {(a, "<") for a in "n=(,F"}
    if language == "py":
        found |= {(a, "N") for a, b in pairs(PRODUCTIONS["py"]["top"] + "N")if b == "N"} | {("N", "N")}
    return found
