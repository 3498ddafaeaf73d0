"""Flat grammars of source languages, over one letter per token.

A bracket's content is a string of its own; in the string around it the bracket is one letter. So no string nests, and a
string is valid if rewriting its operands step by step (a member access, a call, an operator with
its operands become one operand) ends in one of a few statement forms.

Letters: n name, d number, s string, x illegal character; p/h round brackets with and without content, a/Q square ones, o/z braces as a value
or body, B braces as a block; = assignment, E compound assignment, b binary operator, + plus or minus, ! unary operator, * < > & | , ; : ? . @;
A arrow, I ++/--, R ... or <-, U optional chaining, M ::, ~ := in Go and Python. Keywords have a letter per language, see KEYWORDS.
"""

from __future__ import annotations

import re
from functools import lru_cache

_JS = dict(
    function="f", **{"class": "C", "extends": "x", "if": "i", "else": "l", "for": "F", "while": "W", "do": "O", "switch": "S", "case": "c", "default": "D", "return": "r",
    "throw": "t", "try": "T", "catch": "k", "finally": "y", "var": "v", "let": "v", "const": "v", "new": "N", "typeof": "P", "void": "P", "delete": "P", "await": "P", "yield": "P",
    "in": "q", "instanceof": "q", "import": "m", "export": "X", "break": "V", "continue": "V", "debugger": "V", "async": "Z", "get": "g", "set": "g", "static": "g", "from": "u",
    "as": "L", "of": "e", "enum": "J"},
)
#: Letter of each keyword, by language; words that may be names too are decided by their place.
KEYWORDS = {
    "javascript": _JS,
    "typescript": _JS | {"interface": "j", "implements": "x", "type": "w", "namespace": "w", "declare": "w", "module": "w", "keyof": "K", "readonly": "g", "infer": "K", "is": "K", "asserts": "K",
                         "public": "g", "private": "g", "protected": "g", "abstract": "g", "override": "g", "satisfies": "L"},
    "java": {"class": "C", "interface": "C", "enum": "J", "record": "w", "yield": "e", "package": "K", "import": "m", "if": "i", "else": "l", "for": "F", "while": "W", "do": "O", "switch": "S",
             "case": "c", "default": "D", "return": "r", "throw": "t", "try": "T", "catch": "k", "finally": "y", "new": "N", "instanceof": "q", "break": "V", "continue": "V", "assert": "X",
             "extends": "x", "implements": "x", "throws": "x", "permits": "x", "synchronized": "g", "sealed": "g", "goto": "x", "const": "G"}
    | dict.fromkeys("public private protected static final abstract native transient volatile strictfp".split(), "g")
    | dict.fromkeys("int long short byte char boolean float double void".split(), "Y"),
    "go": {"package": "K", "import": "m", "func": "f", "var": "v", "const": "v", "type": "w", "if": "i", "else": "l", "for": "F", "switch": "S", "select": "S", "case": "c",
           "default": "D", "return": "r", "go": "g", "defer": "g", "range": "e", "break": "V", "continue": "V", "goto": "V", "fallthrough": "V", "struct": "C", "interface": "j", "map": "M", "chan": "H"},
    "python": {"def": "f", "class": "C", "if": "i", "elif": "e", "else": "l", "for": "F", "while": "W", "try": "T", "except": "X", "finally": "y", "with": "w", "return": "r",
               "raise": "t", "import": "m", "from": "u", "as": "L", "in": "q", "is": "q", "and": "b", "or": "b", "not": "!", "lambda": "Y", "await": "P", "yield": "r", "async": "Z", "global": "G",
               "nonlocal": "G", "del": "D", "assert": "S", "pass": "V", "break": "V", "continue": "V"},
    "json": {},
}

_NAME = "[nZguLwKefCxilFWOScDrtTkyvNPqmXVjJ]"
_OP = "[nsdpaQoz]"


def _rules(*pairs: tuple[str, str]) -> list[tuple[re.Pattern, str]]:
    return [(re.compile(a), b) for a, b in pairs]


_T0 = r"(?:N?[ph]A)*[KP]*(?:[nsdozphaQ]|P|mp|\+d)[aQ]*"
_T1 = rf"[|&]?{_T0}(?:[|&]{_T0})*"
#: A type, with conditions.
_TY = rf"(?:{_T1}x{_T1}\?{_T1}:)*{_T1}"
_REWRITE = {
    "javascript": _rules(
        (r"Z?f\*?n?[ph]B", "n"), (r"(?<=[nsdphaQoz])[.U](?:[nC]|[pha])", ""), (r"(?<=[npas])[phas](?![A])", ""), (r"(?<=d)[p]", ""), (r"Cn?(?:xn)?[oz]", "n"), (r"m[p](?=.?)|[mN]\.n", "n"),
        (r"([np])I", "n"), (r"(?<![nsdphaQoz])(?:[!+PNI]|P\*)(?=[nsdphaQoz])", ""), (r"N(?=n)", ""),
        (r"(?<![.U])[nsdpaQoz](?:[b+*<q|&]|>{1,3})[nsdpaQoz](?![.UphaI])", "n"), (r"[nsdpaQoz]\?[nsdpaQoz]:[nsdpaQoz](?![.Upha?b+*<q|&>])", "n"),
        (r"Z?[nph]A(?:B|[nsdpaQoz])(?![.Uphab+*<q|&>?=E])", "n"), (r"[npaoz][=E][nsdpaQoz](?![.Uphab+*<q|&>?=EA])", "n"), (r"(?<=[,(^\[])R(?=[nsdpaQoz])|^R(?=[nsdpaQoz])", ""),
        (r"[nsdpaQoz],[nsdpaQoz](?![.Uphab+*<q|&>?=EA:])", "n"),
    ),
    "java": _rules(
        (r"n<[nY?,xQ.&]*>", "n"), (r"[nY]Q*\.C", "n"), (r"(?<=[nsdphaQY])\.(?:n|C|N(?=n))", ""), (r"N[nY](?:[ph][oz]?|a+Q*|Q+[oz])", "n"), (r"(?<=[nps])[pha](?!A)", ""), (r"Sp[oz](?=[;,)]|$)", "n"),
        (r"[nspYQ]+M[nN]", "n"), (r"(?<![nsdphaQoz])[!+I](?=[nsdp])", ""), (r"([np])I", "n"), (r"(?<![nsdphaQYilFWSkT])p(?=[nsdp])(?!p?A)", ""), (r"pn(?=[;,=b+*<>?:|&q]|$)(?<!ipn)(?<!Wpn)(?<!Fpn)", "n"),
        (r"(?<![.])[nsdp](?:[b+*|&]|<{1,2}|>{1,3})[nsdp](?![.phaMI])", "n"), (r"[nsdp]q(?:g?[nY]Q*n?p?)", "n"), (r"[nsdp]\?[nsdp]:[nsdp](?![.phab+*|&<>?q])", "n"),
        (r"[nph]A(?:B|[nsdp])(?![.phab+*|&<>?=E])", "n"), (r"n[=E](?:[nsdp]|[oz])(?![.phab+*|&<>?=EAM])", "n"), (r"(?<![.])[nsdp],[nsdp](?![.phab+*|&<>?=EAMn])", "n"),
    ),
    "go": _rules(
        (r"(?:Q|a|Ma)+\**(?:n(?:\.n)?|C[oz]|j[oz])[ozp]", "n"), (r"C[oz][oz]", "n"), (r"f[ph](?:[*Qa]*n(?:\.n)?|p)?B", "n"), (r"(?<=[nsdphao])\.(?:n|p)", ""), (r"(?<=[np])[phaoz]", ""), (r"(?:Q|Ma|H)+n", "n"),
        (r"(?<![nsdphaQoz])[+!*&R|](?=[nsdp])", ""), (r"[nsdp][b+*&<>|][nsdp](?![.phaoz])", "n"), (r"[nsdp],[nsdp](?![.phaozb+*&<>|])", "n"), (r"[nsdp]:[nsdpoz](?![.phaozb+*&<>|])", "n"),
    ),
    "python": _rules(
        (r"s{2,}", "s"), (r"(?<=[nsdphaQoz])\.n", ""), (r"(?<=[nsphaQo])[pha]", ""), (r"(?<![nsdphaQoz])[!+P](?=[nsdphaQoz])", ""), (r"(?:q!|!q)", "q"),
        (r"[nsdphaQoz](?:[b+*kq<>|&@]|q)[nsdphaQoz](?![.pha])", "n"), (r"[nsdphaQoz]i[nsdphaQoz]l[nsdphaQoz](?![.phab+*kq<>|&@])", "n"),
        (r"Y(?:[*k]?n(?:=[nsdphaQoz])?(?:,[*k]?n(?:=[nsdphaQoz])?)*)?:[nsdphaQoz](?![.phab+*kq<>|&@i])", "n"), (r"n~[nsdphaQoz](?![.phab+*kq<>|&@i])", "n"),
    ),
}
_REWRITE["typescript"] = _rules((r"(?<=n)!(?=[.,;)=ph]|$)", ""), (r"(?<=[nZguw])<[nsdoazQ,|&KP.?:xhpAv+]*>", ""), (rf"(?<=[nsdpaozQ])L(?:v|{_TY})", ""), (rf"(?<=[ph]):K?(?:nK)?{_TY}(?=[BA;]|$)", "")) + _REWRITE["javascript"]

_JS_FORMS = {
    "s": rf";|(?:l?ip|l|FP?p|Wp|O|n:)*(?:B|;|{_OP};?|r(?:{_OP})?;?|t{_OP};?|Vn?;?|Sp[ozB]|OB|OB?Wp;?)|TB|kp?B|yB|v{_OP};?|X(?:D?{_OP}|v{_OP});?",
    "c": _OP, "p": rf"(?:{_OP})?,?", "a": rf"(?:(?:{_OP})?,)*(?:{_OP})?", "o": rf"(?:{_OP})?,?", "F": rf"v?{_OP}|(?:v?{_OP})?;(?:{_OP})?;(?:{_OP})?",
    "M": rf"w?{_NAME}(?:L{_NAME})?(?:,w?{_NAME}(?:L{_NAME})?)*,?",
    "C": rf";|gB|[gZ*wK]*(?:{_NAME}|[sda])[?!]?(?:[;,]?|[ph](?:B|;)?)",
    "j": rf"[gK]*(?:{_NAME}|[sda])\??:{_TY}[;,]?|g?(?:{_NAME})?\??[ph](?::{_TY})?[;,]?|N[ph](?::{_TY})?[;,]?|;",
    "J": r"[ns](?:=[nsdp])?(?:,[ns](?:=[nsdp])?)*,?",
}
_GO_TY = r"(?:\*|Q|a|Ma|R?HR?)*(?:n(?:\.n)?a?|C[oz]|j[oz]|f[ph](?:[*Qa]*n(?:\.n)?|p)?)"
_V = "[nsdp]"
#: Forms in which a rewritten string may end, by language and context: s statement, w statement of a switch, t top level, C class member, j interface member, c condition,
#: F loop head, M import list, J enum, k catch, T resources, p round, a square, o brace content.
FORMS = {
    "javascript": _JS_FORMS,
    "typescript": _JS_FORMS | {"o": rf"(?:{_OP})?,?|(?:[gK]*(?:{_NAME}|[sda])\??:{_TY}[;,]?|(?:{_NAME})?\??[ph](?::{_TY})?[;,]?|a:{_TY}[;,]?)+", "a": _JS_FORMS["a"] + rf"|(?:R?(?:n\??:)?{_TY})(?:,R?(?:n\??:)?{_TY})*,?|nq{_TY}",
                               "p": _JS_FORMS["p"] + rf"|{_TY}"},
    "java": {
        "t": r"Kn;|mg?n(?:\.\*)?;|;|(?:g|w|n\+g)*@?[CJw]n[ph]?(?:xn(?:,n)*)*[oz];?",
        "s": rf";|(?:l?ip|l|Fp|Wp|O|n:)*(?:B|;|{_V};|r(?:{_V})?;|t{_V};|Vn?;|Sp[ozB]|OB|OBWp;|gpB|X{_V}(?::{_V})?;|[we]{_V};)|Tp?B|kpB|yB|g*[nY]Q*n(?:Q*)(?:,n)*;|[gw]*[CJw]n[ph]?(?:xn(?:,n)*)*[oz];?|Wp;",
        "C": r";|g?B|[gD]*(?:[nY]Q*)?n[ph]Q*(?:xn(?:,n)*)?(?:B|;|D[nsdpoz];)|g*[nY]Q*nQ*(?:,n)*;|[gw]*@?[CJw]n[ph]?(?:xn(?:,n)*)*[oz];?|n[ph]?[oz]?(?:,n[ph]?[oz]?)*,?;?",
        "c": _V, "F": rf"(?:(?:g*[nY]Q*)?{_V}(?:,n)*)?;(?:{_V})?;(?:{_V})?|g*[nY]Q*n:{_V}", "k": r"g*n(?:\|n)*n", "T": rf"(?:g*nn|{_V})(?:;(?:g*nn|{_V}))*;?",
        "p": rf"{_V}|g*[nY]Q*R?nQ*(?:,g*[nY]Q*R?nQ*)*|[nY]Q*(?:&n)*|[oz]", "a": _V, "o": rf"(?:{_V}|[oz])(?:,(?:{_V}|[oz]))*,?",
    },
    "go": {
        "t": rf"Kn;?|m(?:[n.]?s|[ph]);?|fp?na?[ph](?:{_GO_TY}|p)?B?;?|v(?:n(?:,n)*(?:{_GO_TY})?(?:={_V})?|[ph]);?|w(?:na?=?{_GO_TY}|[ph]);?|;",
        "s": rf"(?:n:)*(?:{_V}(?:[=E~]{_V})?|{_V}I|{_V}R{_V}|v(?:n(?:,n)*(?:{_GO_TY})?(?:={_V})?|[ph])|w(?:na?=?{_GO_TY}|[ph])|i(?:(?:{_V}(?:[=E~]{_V})?|{_V}I)?;)?{_V}B(?:li(?:(?:{_V}(?:[=E~]{_V})?)?;)?{_V}B)*(?:lB)?"
        rf"|F(?:{_V}|(?:{_V}(?:[=E~]{_V})?)?;(?:{_V})?;(?:{_V}(?:[=E]{_V}|I)?)?|(?:{_V}[=~])?e{_V})?B|S(?:(?:{_V}(?:[=~]{_V})?)?;)?(?:{_V}(?:[=~]{_V})?)?[ozB]|g{_V}|r(?:{_V})?|Vn?|B)?;?",
        "C": rf"(?:n(?:,n)*{_GO_TY}|\*?n(?:\.n)?a?)s?;?", "j": rf"(?:n[ph](?:{_GO_TY}|p)?|{_GO_TY}(?:[|b]{_GO_TY})*);?", "m": "[n.]?s;?", "v": rf"n(?:,n)*(?:{_GO_TY})?(?:={_V})?;?", "W": rf"na?=?{_GO_TY};?",
        "p": rf"{_V}L?,?|(?:nL?{_GO_TY}|L?{_GO_TY}|n)(?:,(?:nL?{_GO_TY}|L?{_GO_TY}|n))*,?|w|(?:{_GO_TY}),{_V},?",
        "a": rf"(?:{_V})?(?::(?:{_V})?){{0,2}}|L|{_GO_TY}(?:,{_GO_TY})*|n(?:,n)*!?{_GO_TY}(?:[|]!?{_GO_TY})*(?:,n(?:,n)*!?{_GO_TY}(?:[|]!?{_GO_TY})*)*", "o": rf"(?:{_V}|[oz])(?:,(?:{_V}|[oz]))*,?",
    },
    "python": {
        "s": r"(?:SIMPLE)(?:;(?:SIMPLE))*;?|@V|(?:HEAD):(?:(?:SIMPLE)(?:;(?:SIMPLE))*;?)?".replace(
            "SIMPLE", r"(?:LIST|r(?:LIST|uV)?)(?:=(?:LIST|r(?:LIST)?))*|VELIST|V:V(?:=LIST)?|t(?:V(?:uV)?)?|K|Gn(?:,n)*|DLIST|SV(?:,V)?|mn(?:Ln)?(?:,n(?:Ln)?)*|u\.*(?:n)?m(?:\*|n(?:Ln)?(?:,n(?:Ln)?)*|p)|nna?=V").replace(
            "HEAD", r"iV|eV|l|Z?FLISTqLIST|Z?FLIST|WV|T|X\*?(?:V(?:Ln)?(?:,V)*)?|y|Z?wV(?:LV)?(?:,V(?:LV)?)*,?|Z?fn[ph]?(?:RV)?|Cn|nLIST(?:LV)?(?:iV)?|nn|fnaph?").replace("LIST", r"\*?V(?:,\*?V)*,?").replace("K", "V_").replace("V_", "\x00").replace("V", "[nsdphaQoz]").replace("\x00", "V"),
        "p": r"(?:ARG)(?:,(?:ARG))*,?|r(?:V)?".replace("ARG", r"[*k]?n?V?(?::\*?V)?(?:=V)?(?:Ln)?(?:Z?FV(?:,V)*(?:qV)?(?:iV)*)*|[*b]").replace("V", "[nsdphaQoz]"),
        "a": r"(?:ARG)(?:,(?:ARG))*,?".replace("ARG", r"[*]?(?:V)?(?::(?:V)?){0,2}(?:Z?FV(?:,V)*(?:qV)?(?:iV)*)*").replace("V", "[nsdphaQoz]"),
        "o": r"(?:ARG)(?:,(?:ARG))*,?".replace("ARG", r"(?:[*k]?V(?::V)?)(?:Z?FV(?:,V)*(?:qV)?(?:iV)*)*").replace("V", "[nsdphaQoz]"),
    },
    "json": {"t": "[nsdoazQ]", "o": "s:[nsdoazQ](?:,s:[nsdoazQ])*", "a": "[nsdoazQ](?:,[nsdoazQ])*"},
}

_SPECIAL = {
    "javascript": re.compile(rf"m(?:s|(?:[nZguLwKe]|[oz]|\*L[nZguLwKe])(?:,(?:[oz]|\*L[nZguLwKe]))?us(?:no)?);?|X(?:[oz](?:us(?:no)?)?|\*(?:L{_NAME})?us(?:no)?);?|XD?Z?f\*?n?[ph]B|XD?Cn?(?:xn)?[oz]"),
    "typescript": re.compile(
        rf"m(?:s|w?(?:[nZguLwKe]|[oz]|\*L[nZguLwKe])(?:,(?:[oz]|\*L[nZguLwKe]))?us);?|X(?:w?[oz](?:us)?|\*(?:L{_NAME})?us);?|X?D?w*Z?f\*?[nZguw]?[ph](?:B|;)?|X?D?[gw]*C[nguw]?(?:xn(?:p|,n)*)*[oz]"
        rf"|X?D?w*j[nguw](?:xn(?:,n)*)*[oz]|X?w*v?J[nguw][oz]|X?w*w[nguwL]={_TY};?|X?w+(?:n(?:\.n)*|s)[ozB]|X=n;?|X?w*v(?:n|[aoz])!?:{_TY};?|X?w+v{_OP};?"
    ),
}


@lru_cache(maxsize=1)
def _forms() -> dict[tuple[str, str], re.Pattern]:
    out = {}
    for lang, by in FORMS.items():
        for ctx, rule in by.items():
            out[lang, ctx] = re.compile(rule)
        if lang == "java":
            out[lang, "J"] = out[lang, "C"]
            # A record's body may have a constructor without a list of parameters.
            out[lang, "R"] = re.compile(by["C"] + "|g*nB")
        if "s" in by:
            label = {"java": r"|c[nsdpY](?:n|p)?(?:,[nsdpD])*[:A](?:B|[nsdp];)?|D[:A](?:B|[nsdp];)?", "go": rf"|c(?:[nsdp](?:[=~]n|R[nsdp])?|{_GO_TY}(?:,{_GO_TY})*):|D:"}.get(lang, rf"|c{_OP}:|D:")
            out[lang, "w"] = re.compile(f"(?:{by['s']}){label}")
    return out


def rewrite(lang: str, kinds: str) -> str:
    """Rewrites operands until nothing changes; every rule shortens the string or is applied once, so it ends."""
    rules = _REWRITE[lang]
    for _ in range(len(kinds) + 2):
        before = kinds
        for rx, to in rules:
            kinds, n = rx.subn(to, kinds)
            if n:
                break
        if kinds == before:
            return kinds
    return kinds


#: What may stand before a statement without ending it.
_HEADS = re.compile(r"(?:l?ip|l|FP?p|Wp|O|n:)+")
#: A class or function declared without a name, and an expression that is no statement.
_NAMELESS = re.compile(r"C(?:[oz]|xn[oz])|Z?f\*?[ph]B$")
_NO_STATEMENT = re.compile(r"(?:l?ip|l|Fp|Wp|O|n:)*[nsd](?:\.n|a|[b+*&|][+!]?[nsd])*;")


def _complete(lang: str, ctx: str, form: re.Pattern, t: str) -> bool:
    """Whether a string rewrites to a form of its context, as a whole or behind the heads of the statements around it."""
    if form.fullmatch(t) or form.fullmatch(rewrite(lang, t)):
        return True
    m = _HEADS.match(t) if ctx in ("s", "w") else None
    return bool(m and m.end() < len(t) and (form.fullmatch(t[m.end() :]) or form.fullmatch(rewrite(lang, t[m.end() :]))))


def holds(lang: str, ctx: str, kinds: str) -> bool:
    """Whether a flat string is a production of its context."""
    form = _forms().get((lang, ctx))
    if form is None:
        return False
    if lang == "json":
        return bool(form.fullmatch(kinds))
    # Long lists of like elements are cut to two; this changes nothing for the forms.
    kinds = re.sub(r"((?:[sdnoap]|\+d),)\1{2,}", r"\1\1", kinds)
    if "`" in kinds:  # an illegal character or an unclosed literal
        return False
    if lang in ("javascript", "typescript"):
        t = kinds
        if ctx in ("s", "w") and _NAMELESS.match(t):
            return False
        if lang == "typescript":
            for _ in range(6):
                t, n = re.subn(r"(?<=[nZguLwKe])<[nsdoazQ,|&KP.?:xhpAv+=w]*>", "", t)
                if not n:
                    break
            t = re.sub(r"(?:(?<=[=,:?r&|!+b])|^)<[nsdoazQ,|&KP.?:xhpA]*>(?=[nsphao])", "", t)
            if not t.startswith(("w", "Xw")):
                t = re.sub(r"(?<=[np])\.n", "", t)
            t = re.sub(rf"(?<=[ph]):K?(?:[nuw]K)?{_TY}(?=[BA;]|$)", "", t)
            if re.match("[Xw]*v", t):
                t = re.sub(rf"([,v][naoz])!?:{_TY}(?=[=,;]|$)", r"\1", t)
            elif re.match("[Xw]*w[nguwL]=", t):
                t = re.sub(r"(?<=[np])\.n", "", t)
        t = re.sub(r"@n(?:\.n)*[ph]?", "", t)
        if ctx in ("s", "w") and _SPECIAL[lang].fullmatch(t):
            return True
        if ctx in ("j", "M") and form.fullmatch(t):
            return True
        if ctx == "F":
            if not re.search(r"[qe;]", t):
                return False
            t = re.sub(r"(?<=[nao])e(?=.)", "q", t)
        if ctx == "o":
            if lang == "typescript" and form.fullmatch(t):
                return True
            t = re.sub(rf"(^|,)(?:[gZ]|\*)*(?:{_NAME}|[sda])[ph]B", r"\1n", t)
            t = re.sub(rf"(^|,)(?:{_NAME}|[sda]):", r"\1", t)
            t = re.sub(r"(^|,)R", r"\1", t)
        if ctx in ("p", "a"):
            if lang == "typescript":
                if form.fullmatch(t):
                    return True
                t = re.sub(rf"(^|,)g*(R?[nZguLwKeoa])\??:{_TY}(?=[,=]|$)", r"\1\2", t)
                t = re.sub(r"(^|,)g+(?=R?[nZuLwKeoa])", r"\1", t)
                t = re.sub(r"(^|,)g*(R?[nZguLwKe])\?(?=[,=]|$)", r"\1\2", t)
            t = re.sub(r"(^|,)R", r"\1", t)
        if ctx == "C":
            m = re.fullmatch(rf"([gZ*wK]*(?:{_NAME}|[sda])[?!]?)(?::{_TY})?(?:=(.+?))?([;,]?)", t)
            if m and (m[2] is None or holds(lang, "c", m[2])):
                return True
            return bool(form.fullmatch(t))
        t = re.sub(r"Z(?!f|[nph]A)", "n", t)
        t = re.sub(r"[guLwKe]" if lang == "javascript" else r"[guwKe]", "n", t)
        return _complete(lang, ctx, form, t)
    if lang == "java":
        t = re.sub(r"@n(?:\.n)*[ph]?(?!C)", "", kinds)
        if ctx != "t" and not re.search(r"^[gw]*wn(?:<.*?>)?[ph]", t):
            t = t.replace("w", "n")
        for _ in range(6):
            t, n = re.subn(r"(?<=[nw])<[nY?,xQ.&]*>|(?:^|(?<=[g.M]))<[nYx,.&?Q]*>", "", t)
            if not n:
                break
        if ctx == "t":
            return bool(form.fullmatch(re.sub(r"(?<=n)\.n", "", t)))
        if ctx in ("p", "k", "C", "J", "R", "F", "T") and form.fullmatch(re.sub(r"(?<=n)\.n", "", t)):
            return True
        m = re.fullmatch(r"(g*[nY](?:\.n)*Q*n)(?:Q*)=(.+);", t) if ctx in ("C", "J", "R", "s", "w") else None
        if m and re.fullmatch(r"[oznsdp](?:,n)*", rewrite(lang, m[2])):
            return True
        m = re.fullmatch(r"(.*[ph]Q*)D(.+);", t) if ctx == "C" else None
        if m and re.fullmatch(r"[nsdpoz]", rewrite(lang, m[2])):
            return bool(form.fullmatch(re.sub(r"(?<=n)\.n", "", m[1]) + ";"))
        if ctx in ("s", "w"):
            if _NO_STATEMENT.fullmatch(t):
                return False
            guard = re.fullmatch(r"c(?:g*[nY](?:\.n)*Q*(?:n|pn?))n(.+?)([:A].*)", t) if ctx == "w" else None
            if guard and re.fullmatch(r"[nsdp]", rewrite(lang, guard[1])):
                t = "cn" + guard[2]
        return _complete(lang, ctx, form, t)
    if lang == "go":
        if form.fullmatch(kinds):
            return True
        return bool(form.fullmatch(rewrite(lang, kinds)))
    return bool(form.fullmatch(rewrite(lang, kinds)))


# ---- adjacency ----

#: What ``holds`` takes away or puts in before it rewrites, by language and context ('' for all): the same patterns, for the derivation of pairs. A text that is
#: taken away is named with the letters it stands behind (post) or before (pre).
_OPERANDS = "nsdphaQoz"
_TAKEN = {
    "javascript": [("", "name", "[ZguLwKe]", ""), ("o", "pre", rf"(?:[gZ]|\*)*(?:{_NAME}|[sda])[ph]B|(?:{_NAME}|[sda]):|R", ""), ("p", "pre", "R", ""), ("a", "pre", "R", ""), ("F", "pair", r"[nao]e[nsdpaQoz]", ""), ("C", "pair", r"=n", "")],
    "java": [("", "pre", r"@n(?:\.n)*[ph]?", _OPERANDS + "gYCJw@"), ("", "post", r"<[nY?,xQ.&]*>", "nw.Mg"), ("C", "pre", r"<[nYx,.&?Q]*>", _OPERANDS + "Y"), ("J", "pre", r"<[nYx,.&?Q]*>", _OPERANDS + "Y"), ("R", "pre", r"<[nYx,.&?Q]*>", _OPERANDS + "Y"), ("w", "pair", r"cg*[nY]Q*(?:n|pn?)n[nsdp]", ""), ("w", "pair", "[nsdp][:A]", ""), ("", "post", r"\.n", "n"), ("", "name", "[w]", ""), ("", "pair", r"g*[nY](?:\.n)*Q*nQ*=[nozsdp]", ""), ("", "pair", r"g<n", ""), ("C", "pair", r"[ph]Q*D[nsdpozY@+]", ""), ("", "pair", r"g@n|@nC", "")],
    "go": [],
    "python": [],
    "json": [],
}
_TAKEN["typescript"] = _TAKEN["javascript"] + [
    ("", "post", r"<[nsdoazQ,|&KP.?:xhpAv+=w]*>", "nZguLwKe"), ("", "pre", r"<[nsdoazQ,|&KP.?:xhpA]*>", "nsphao"), ("", "pair", rf"[,v][naoz]!?:{_TY}[=,;]", ""), ("p", "pre", "g+", "nZuLwKeoaR"), ("a", "pre", "g+", "nZuLwKeoaR"), ("", "post", rf":K?(?:[nuw]K)?{_TY}", "ph"), ("", "post", rf":{_TY}", "naoz"), ("", "pre", r"@n(?:\.n)*[ph]?", ""),
    ("p", "pair", rf"g*(?:R?[nZguLwKeoa])\??:{_TY}[,=]?", ""), ("a", "pair", rf"g*(?:R?[nZguLwKeoa])\??:{_TY}[,=]?", ""), ("p", "post", r"\?", "nZguLwKe"), ("", "post", "[!?]", "nao"),
]


class _Ends:
    """What a pattern can begin and end with, whether it can be empty, and which letters can stand side by side in it."""

    def __init__(self, empty: bool, first: frozenset, last: frozenset):
        self.empty, self.first, self.last = empty, first, last


def _letters_of(items) -> frozenset:
    from re import _constants as c

    out = set()
    for op, v in items:
        if op is c.LITERAL:
            out.add(chr(v))
        elif op is c.RANGE:
            out |= {chr(x) for x in range(v[0], v[1] + 1)}
    return frozenset(out)


def _walk(parsed, pairs: set) -> _Ends:
    """The ends of a parsed pattern; adjacent letters are added to ``pairs``. Conditions that look around are empty."""
    from re import _constants as c

    whole = _Ends(True, frozenset(), frozenset())
    for op, v in parsed:
        if op is c.LITERAL:
            e = _Ends(False, frozenset(chr(v)), frozenset(chr(v)))
        elif op is c.IN:
            x = _letters_of(v)
            e = _Ends(False, x, x)
        elif op in (c.ANY, c.GROUPREF):
            e = _Ends(False, frozenset("n"), frozenset("n"))
        elif op is c.BRANCH:
            parts = [_walk(x, pairs) for x in v[1]]
            e = _Ends(any(x.empty for x in parts), frozenset().union(*[x.first for x in parts]), frozenset().union(*[x.last for x in parts]))
        elif op is c.SUBPATTERN:
            e = _walk(v[3], pairs)
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            least, most, body = v
            e = _walk(body, pairs)
            if most > 1:
                pairs |= {(x, y) for x in e.last for y in e.first}
            e = _Ends(e.empty or least == 0, e.first, e.last)
        else:
            continue
        pairs |= {(x, y) for x in whole.last for y in e.first}
        whole = _Ends(whole.empty and e.empty, whole.first | e.first if whole.empty else whole.first, whole.last | e.last if e.empty else e.last)
    return whole


def _around(parsed) -> tuple[frozenset, frozenset]:
    """The letters that the conditions of a pattern ask for behind and before it."""
    from re import _constants as c

    behind, before = set(), set()
    for op, v in parsed:
        if op is c.ASSERT:
            e = _walk(v[1], set())
            (behind if v[0] < 0 else before).update(e.last if v[0] < 0 else e.first)
        elif op is c.SUBPATTERN:
            x, y = _around(v[3])
            behind |= x
            before |= y
    return frozenset(behind), frozenset(before)


def _derived(lang: str, ctx: str) -> set[str]:
    """The pairs that a language's productions permit in a context.

    Of the context's form and of every rewriting rule, the letters that may stand side by side are read off its pattern. An operand may begin with what a rule that makes one begins
    with, and end with what such a rule ends with; what a rule takes away lengthens the operand it stands by. A pair of operands in a production thus stands for every end of the one
    beside every beginning of the other.
    """
    parse = re._parser.parse
    base: set = set()
    begins: dict[str, set] = {}
    ends: dict[str, set] = {}

    def more(of: dict[str, set], key: str, letters) -> None:
        of.setdefault(key, {key}).update(letters)

    def takes(kind: str, e: _Ends, by: frozenset) -> None:
        for x in by:
            if kind == "post":
                more(ends, x, e.last)
                base.update((x, y) for y in e.first)
            else:
                more(begins, x, e.first)
                base.update((y, x) for y in e.last)

    for rx, to in _REWRITE.get(lang, ()):
        parsed = parse(rx.pattern)
        e = _walk(parsed, base)
        made = to[-1:].replace("1", "n")
        if made:
            more(begins, made, e.first)
            more(ends, made, e.last)
            continue
        behind, before = _around(parsed)
        if behind:
            takes("post", e, behind)
        if before or not behind:
            takes("pre", e, before or frozenset(_OPERANDS))
    for where, kind, pattern, by in _TAKEN[lang]:
        if where not in ("", ctx):
            continue
        e = _walk(parse(pattern), base)
        if kind == "name":
            more(begins, "n", e.first)
            more(ends, "n", e.last)
        elif kind != "pair":
            takes(kind, e, frozenset(by or _OPERANDS))
    for of in (begins, ends):
        while any([len(v) < len(v.update(*[of.get(x, ()) for x in list(v)]) or v) for v in of.values()]):
            pass
    _walk(parse(_forms()[lang, ctx].pattern), base)
    if ctx in ("s", "w") and lang in _SPECIAL:
        _walk(parse(_SPECIAL[lang].pattern), base)
    return {x + y for a, b in base for x in ends.get(a, {a}) for y in begins.get(b, {b})}


@lru_cache(maxsize=1)
def permissible_pairs() -> list[tuple[str, str, str]]:
    """(language, context, pair): letters that may stand side by side in some production of the context; fixed by the grammars."""
    return [(lang, ctx, pair) for lang, ctx in sorted(_forms()) for pair in sorted(_derived(lang, ctx))]
