"""Grammars of the languages in which line ends, indentation or names matter: Python, shell, JSON, YAML, XML."""

from __future__ import annotations

import re
from collections.abc import Callable

from siltline.llm.grammars import BAD, CLASSES, Language, _class_map, _fill, flat_expression
from siltline.llm.packrat import END, Grammar

# -- Python ------------------------------------------------------------------------------------------------------------

_PYTHON = r"""
file <- NL? stmt* END
stmt <- compound / simple_line
simple_line <- simple (';' simple)* ';'? NL
simple <- 'pass' / 'break' / 'continue' / 'return' exprs_star? / 'raise' (expr ('from' expr)?)? / 'global' ID (',' ID)* / 'nonlocal' ID (',' ID)* / 'del' targets / 'assert' expr (',' expr)? / import / typealias / expr_stmt
typealias <- 'type' ID typeparams? '=' expr
import <- 'import' dotted ('as' ID)? (',' dotted ('as' ID)?)* / 'from' ('.' / '...')* (dotted / &'import') 'import' ('*' / '(' alias (',' alias)* ','? ')' / alias (',' alias)*)
dotted <- ID ('.' ID)*
alias <- ID ('as' ID)?
expr_stmt <- exprs_star &STOP / targets '=' assigned / single (':' expr ('=' (yield / exprs_star))? / AUG (yield / exprs_star)) / yield
assigned <- (yield / exprs_star) !'=' / targets '=' assigned
single <- access / ID / '(' single ')'
access <- atom (suffix &SUFFIX)* ('.' ID / '[' subscript (',' subscript)* ','? ']')
exprs <- expr (',' expr)* ','?
exprs_star <- star_expr (',' star_expr)* ','?
star_expr <- %flat% &FOLLOW / '*' bitor / yield / named
compound <- decorator* (class / 'async'? def) / if / 'async'? for / while / try / 'async'? with / match
decorator <- '@' named NL
block <- NL INDENT stmt+ DEDENT / simple_line
class <- 'class' ID typeparams? args? ':' block
def <- 'def' ID typeparams? '(' params? ')' ('->' expr)? ':' block
typeparams <- '[' ('*' / '**')? ID (':' expr)? ('=' expr)? (',' ('*' / '**')? ID (':' expr)? ('=' expr)?)* ','? ']'
params <- (positional (',' named_only)? / named_only) ','?
positional <- plain (',' plain)* (',' '/' (',' plain)* (',' given)* / (',' given)+ (',' '/')? (',' given)*)? / given (',' given)* (',' '/')? (',' given)*
plain <- ID (':' expr)? !'='
given <- ID (':' expr)? '=' expr
named_only <- '*' ID (':' ('*' bitor / expr))? (',' either)* (',' rest)? / '*' (',' either)+ (',' rest)? / rest
either <- ID (':' expr)? ('=' expr)?
rest <- '**' ID (':' expr)?
if <- 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)?
while <- 'while' named ':' block ('else' ':' block)?
for <- 'for' targets 'in' exprs_star ':' block ('else' ':' block)?
targets <- target (',' target)* ','?
target <- '*' target / access / ID / '(' targets? ')' / '[' targets? ']'
try <- 'try' ':' block (('except' '*'? (expr (',' expr)* ('as' ID)?)? ':' block)+ ('else' ':' block)? ('finally' ':' block)? / 'finally' ':' block)
with <- 'with' ('(' withitem (',' withitem)* ','? ')' ':' / withitem (',' withitem)* ':') block
withitem <- expr ('as' target)?
match <- 'match' exprs_star ':' NL INDENT ('case' patterns ('if' named)? ':' block)+ DEDENT
patterns <- pattern (',' pattern)* ','?
pattern <- '*' ID / orpattern ('as' ID)?
orpattern <- closed ('|' closed)*
closed <- '-'? NUM (('+' / '-') NUM)? / STR+ / 'None' / 'True' / 'False' / ID ('.' ID)* ('(' ((ID '=')? pattern (',' (ID '=')? pattern)* ','?)? ')')? / '(' patterns? ')' / '[' patterns? ']' / '{' (mapitem (',' mapitem)* ','?)? '}'
mapitem <- '**' ID / closed ':' pattern
yield <- 'yield' ('from' expr / exprs_star)?
named <- %flat% &FOLLOW / ID ':=' expr / expr
expr <- lambda / or ('if' or 'else' expr)?
lambda <- 'lambda' lparams? ':' expr
lparams <- (lpositional (',' lnamed_only)? / lnamed_only) ','?
lpositional <- lplain (',' lplain)* (',' '/' (',' lplain)* (',' lgiven)* / (',' lgiven)+ (',' '/')? (',' lgiven)*)? / lgiven (',' lgiven)* (',' '/')? (',' lgiven)*
lplain <- ID !'='
lgiven <- ID '=' expr
lnamed_only <- '*' ID (',' leither)* (',' lrest)? / '*' (',' leither)+ (',' lrest)? / lrest
leither <- ID ('=' expr)?
lrest <- '**' ID
or <- not (('and' / 'or') not)*
not <- 'not'* compare
compare <- bitor ((COMPARE / 'not' 'in' / 'is' 'not' / 'is' / 'in') bitor)*
bitor <- unary (BIN unary)*
unary <- PRE* 'await'? postfix
postfix <- atom suffix*
suffix <- '.' ID / args / '[' subscript (',' subscript)* ','? ']'
subscript <- '*' bitor / expr? ':' expr? (':' expr?)? / named
args <- '(' (arg (',' arg)* (',' keyword)* (',' last)* ','? / keyword (',' keyword)* (',' last)* ','? / last (',' last)* ','?)? ')' / '(' named comp ')'
arg <- !(ID '=') (%flat% &FOLLOW / '*' expr / named)
keyword <- ID '=' (%flat% &FOLLOW / expr) / '*' expr
last <- '**' expr / ID '=' expr
comp <- ('async'? 'for' targets 'in' or ('if' cond_nocond)*)+
cond_nocond <- ID ':=' or / or
atom <- ID / NUM / STR+ / 'None' / 'True' / 'False' / '...' / '(' (yield / tuple_items)? ')' / '[' tuple_items? ']' / '{' (dict_items / tuple_items)? '}'
tuple_items <- star_named (comp / (',' star_named)* ','?)
star_named <- '*' bitor / named
dict_items <- dict_item (comp / (',' dict_item)* ','?)
dict_item <- '**' bitor / expr ':' expr
"""
_PYTHON_SETS = {
    "ID": "NAME match case type _ print exec",
    "AUG": "+= -= *= /= //= %= @= &= |= ^= <<= >>= **=",
    "COMPARE": "== != < > <= >=",
    "BIN": "+ - * / // % @ ** << >> & | ^",
    "PRE": "+ - ~",
    "SIMPLE": "NAME NUM STR None True False",
    "OPERATOR": "+ - * / // % @ ** << >> & | ^ == != < > <= >= and or in is",
    "FOLLOW": "; , ) ] } : NL =",
    "STOP": "; NL",
    "SUFFIX": ". ( [",
}


_FIELD_SIGN = re.compile(r"\{\{|\}\}|\\N\{[^}]*\}|\\[^{}]|\{|\}")
_FIELD_PART = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'\''[\s\S]*?'\''|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|!=|==|<=|>=|[()\[\]{}!:=]")
_PLAIN_FIELD = re.compile(r"\s*[A-Za-z_]\w*(?:\.[A-Za-z_]\w*|\[\d+\]|\(\))*\s*")


def _fields_parse(token: str, accepts: Callable[[str], bool]) -> bool:
    """Whether braces of a formatted literal pair and their expressions parse."""
    start = token.index(next(q for q in token if q in "\"'"))
    width = 3 if token[start : start + 3] in ('"' * 3, "'" * 3) and len(token) >= start + 6 else 1
    return _fields_end(token[start + width : -width], 0, accepts, False) >= 0


def _fields_end(body: str, at: int, accepts: Callable[[str], bool], inside: bool) -> int:
    """Behind the text that begins at ``at``, or -1 if a field in it is wrong; a format ends before its closing brace."""
    while True:
        sign = _FIELD_SIGN.search(body, at)
        if sign is None:
            return -1 if inside else len(body)
        if sign[0] == "}" or inside and sign[0] == "}}":
            return sign.start() if inside else -1
        if sign[0] != "{" and not (inside and sign[0] == "{{"):
            at = sign.end()
            continue
        begin, depth, at = sign.start() + 1, 0, sign.start() + 1
        while True:
            part = _FIELD_PART.search(body, at)
            if part is None:
                return -1
            if part[0] in ("(", "[", "{"):
                depth += 1
            elif part[0] in (")", "]", "}") and depth:
                depth -= 1
            elif not depth and part[0] in ("}", "!", ":") or not depth and part[0] == "=" and re.match(r"\s*[!:}]", body[part.end() :]):
                break
            at = part.end()
        expression = body[begin : part.start()]
        if not _PLAIN_FIELD.fullmatch(expression) and not (expression.strip() and accepts(expression)):
            return -1
        at = part.start()
        rest = re.match(r"\s*=?\s*(?:![rsa])?\s*([:}])", body[at:])
        if rest is None:
            return -1
        at += rest.end()
        if rest[1] == ":":
            at = _fields_end(body, at, accepts, True)
            if at < 0 or body[at : at + 1] != "}":
                return -1
            at += 1


def _python() -> Language:
    grammar = Grammar(_fill(_PYTHON, {"flat": flat_expression("SIMPLE", "'.' ID", "OPERATOR", "ID '='")}), CLASSES, _PYTHON_SETS)
    c, t = grammar.kinds.of_class, grammar.kinds.of_text
    prefix = r"(?:[rRbBuUfFtT]{1,2})?"
    number = r"0[xX][\da-fA-F_]++(?!\w)|0[bBoO][\d_]++(?!\w)|(?:(?:0(?:_?0)*+|[1-9](?:_?\d)*+)(?![\d_.eEjJ])|(?:\d(?:_?\d)*+\.(?:\d(?:_?\d)*+)?|\.\d(?:_?\d)*+|\d(?:_?\d)*+(?=[eEjJ]))(?:[eE][+-]?\d(?:_?\d)*+)?[jJ]?)(?!\w)"
    # fields of formatted literals may hold the quotes that enclose the literal; what doesn't match is read as any literal
    field = r"\{(?:[^{}\"'\n#]|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|\{[^{}\n]*\})*+\}"
    formatted = r"(?:[fFtT][rR]?|[rR][fFtT])"
    nested = rf"{formatted}\"(?!\"\")(?:[^\"\\\n{{}}]|\\[\s\S]|\{{\{{|\}}\}}|{field})*+\"|{formatted}'(?!'')(?:[^'\\\n{{}}]|\\[\s\S]|\{{\{{|\}}\}}|{field})*+'"
    pattern = re.compile(
        rf'#[^\n]*+|{nested}|{prefix}"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""|{prefix}\'\'\'(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*+\'\'\'|{prefix}"(?:[^"\\\n]|\\[\s\S])*+"(?!")|{prefix}""(?!")|{prefix}\'(?:[^\'\\\n]|\\[\s\S])*+\'(?!\')|{prefix}\'\'(?!\')'
        rf"|[^\W\d]\w*+|\n[ \t\f]*+(?:(?:#[^\n]*+)?\n[ \t\f]*+)*+(?:#[^\n]*+)?|\\\n|{number}|\*\*=|//=|<<=|>>=|\.\.\.|->|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|\*\*|//|<<|>>|\S"
    )
    is_string = re.compile(prefix + "[\"']")
    table = _class_map(grammar) | {"#": "", "\\": lambda token: "" if token == "\\\n" else BAD}
    is_formatted = re.compile(formatted + "[\"']")

    def literal(token: str) -> str:
        if token[-1] not in "\"'" or not is_string.match(token):
            return c["NAME"]
        return c["STR"] if "{" not in token and "}" not in token or not is_formatted.match(token) or _fields_parse(token, accepts) else BAD

    def accepts(expression: str) -> bool:
        return language.grammar.accepts(language.kinds(f"({expression})\n"))

    for letter in "rRbBuUfFtT":
        table[letter] = literal
    table["@"] = BAD
    language = Language("python", grammar, pattern, table)
    brackets = re.compile("[" + "".join(re.escape(t[x]) for x in "([{") + "]|[" + "".join(re.escape(t[x]) for x in ")]}") + "]|" + c["NL"])
    opening = "".join(t[x] for x in "([{")

    def width(line_end: str) -> int:
        indent = line_end[line_end.rfind("\n") + 1 :].replace("\f", "")
        return len(indent.expandtabs(8)) if "\t" in indent else len(indent)

    def finish(raw: str, ends: list[str], first: int) -> tuple[str, list[tuple[int, int]]]:
        """Kinds with INDENT and DEDENT; and for each piece where it begins in the output and in the input."""
        out, marks, depth, at, n, levels, length = [], [], 0, 0, 0, [first], 0

        def put(piece: str, origin: int) -> None:
            nonlocal length
            if piece:
                marks.append((length, origin))
                out.append(piece)
                length += len(piece)

        for m in brackets.finditer(raw):
            k = m[0]
            if k == c["NL"]:
                put(raw[at : m.start()], at)
                at = m.end()
                line_end = ends[n]
                n += 1
                last = m.end() == len(raw)
                if depth == 0 and not (last or line_end[-1:] not in " \t\f\n" and "#" in line_end[line_end.rfind("\n") :]):
                    put(c["NL"], m.start())
                    indent = width(line_end)
                    if indent > levels[-1]:
                        levels.append(indent)
                        put(c["INDENT"], m.start())
                    else:
                        while len(levels) > 1 and indent < levels[-1]:
                            levels.pop()
                            put(c["DEDENT"], m.start())
                        if indent != levels[-1]:
                            put(BAD, m.start())
                elif depth == 0:
                    put(c["NL"], m.start())
            elif k in opening:
                depth += 1
            elif depth:
                depth -= 1
        put(raw[at:], at)
        if out and out[-1][-1] != c["NL"]:
            put(c["NL"], len(raw))
        put(c["DEDENT"] * (len(levels) - 1), len(raw))
        return "".join(out), marks

    def lex(text: str) -> tuple[list[str], list[int]]:
        body = text.lstrip(" \t\f") if text[:1] in " \t\f" else text
        lead = re.match(r"(?:[ \t\f]*+(?:#[^\n]*+)?\n)*+([ \t\f]*+)", text)
        first = 1 if lead[1] and text[lead.end() : lead.end() + 1] not in ("", "#", "\n") else 0
        del body
        tokens = pattern.findall(text)
        get, kind = language.cache.get, language.kind
        raw = "".join([get(x) or kind(x) for x in tokens])
        ends = [x for x in tokens if x[0] == "\n"]
        head = 0
        if raw[:1] == c["NL"]:  # comments and empty lines first
            raw, ends, head = raw[1:], ends[1:], 1
        kinds, marks = finish(raw, ends, 0)
        if first:
            kinds = BAD + kinds
        lex.raw = (marks, head)
        return list(kinds), _Places(language, text, marks, head)

    language.lexer = lex
    return language


class _Places:
    """Offsets of the kinds of a Python text, worked out when they are asked for."""

    def __init__(self, language: Language, text: str, marks: list[tuple[int, int]], head: int):
        self.args = language, text, marks, head
        self.length = 1 << 60

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, position: int) -> int:
        language, text, marks, head = self.args
        starts = [m.start() for m in language.pattern.finditer(text) for _ in language.kind(m[0])][head:]
        at = 0
        for begin, origin in marks:
            if begin <= position:
                at = origin + position - begin
        return starts[at] if at < len(starts) else len(text)


# -- shell -------------------------------------------------------------------------------------------------------------

_SHELL = r"""
file <- list END
list <- NL* (andor ((';' / '&' / NL) NL* / &END / &')' / &'}' / &CLOSER))*
andor <- pipeline (('&&' / '||') NL* pipeline)*
pipeline <- ('!' / 'time')* command (('|' / '|&') NL* command)*
command <- compound redirect* / function / simple
compound <- brace / '(' list ')' / if / for / while / case / ARITH / TEST
brace <- '{' &(NL / NAME / 'SPACE' / ANY) body '}'
body <- NL* andor ((';' / '&' / NL) NL* andor?)*
if <- 'if' body 'then' body ('elif' body 'then' body)* ('else' body)? 'fi'
for <- ('for' / 'select') (word (NL* 'in' word*)? / ARITH) (';' / NL)* ('do' body 'done' / brace)
while <- ('while' / 'until') body 'do' body 'done'
case <- 'case' word NL* 'in' NL* (!'esac' '('? word ('|' word)* ')' list (';;' / ';&' / ';;&' / &'esac') NL*)* 'esac'
function <- ('function' word ('(' ')')? / NAME '(' ')') NL* compound redirect*
simple <- (array / redirect)* !RESERVED NAME (word / array / redirect)* / (array / redirect)+
array <- ARRAY (NL / word)* ')'
redirect <- REDIRECT word
word <- NAME / RESERVED / '{' / '}' / '!' / 'time' / 'in' / 'function' / 'select' / 'SPACE' / 'for' / 'if' / 'case' / 'while' / 'until'
"""
_SHELL_SETS = {"RESERVED": "then else elif fi do done esac", "CLOSER": "then else elif fi do done esac ;; ;& ;;&", "ARITH": "(())", "TEST": "[[]]", "REDIRECT": "<>", "ARRAY": "=("}


def _nested(depth: int) -> str:
    """Text in which brackets pair up to a depth; a case stands for itself, as its patterns close brackets that none opens."""
    case = r"(?<![\w$.-])case\s(?:(?!\besac\b)[\s\S])*+esac\b"
    inner = rf"(?:{case}|[^()\"'\\`]|\\[\s\S]|\"(?:[^\"\\]|\\[\s\S])*+\"|'[^']*+'|`[^`]*+`)*+"
    for _ in range(depth):
        inner = rf"(?:{case}|[^()\"'\\`]|\\[\s\S]|\"(?:[^\"\\]|\\[\s\S])*+\"|'[^']*+'|`[^`]*+`|\({inner}\))*+"
    return inner


def _commands(token: str, substitution: re.Pattern) -> list[str]:
    """The code of the command substitutions of a word, outermost only; arithmetic is none."""
    out, at, quoted = [], 0, False
    while at < len(token):
        if token[at] == "\\":
            at += 2
        elif token[at] == "'" and not quoted:
            at = token.find("'", at + 1) + 1 or len(token)
        elif token.startswith("$(", at):
            found = substitution.match(token, at)
            if found and not token.startswith("$((", at):
                out.append(token[at + 2 : found.end() - 1])
            at = found.end() if found else at + 2
        else:
            quoted ^= token[at] == '"'
            at += 1
    return out


def _shell() -> Language:
    grammar = Grammar(_SHELL, CLASSES, _SHELL_SETS)
    t, c = grammar.kinds.of_text, grammar.kinds.of_class
    sub = rf"\$\({_nested(4)}\)"
    brace = r"\$\{(?:[^{}\"'\\]|\\[\s\S]|\"(?:[^\"\\]|\\[\s\S])*+\"|'[^']*+'|\{[^{}]*+\}|\$\{[^{}]*+\})*+\}"
    double = rf'"(?:[^"\\$`]|\\[\s\S]|{sub}|{brace}|\$(?![({{])|`(?:[^`\\]|\\[\s\S])*+`)*+"'
    part = rf"(?:[^\s\"'\\$`;&|<>()\x00]|\\[\s\S]|\$'(?:[^'\\]|\\[\s\S])*+'|'[^']*+'|{double}|{sub}|{brace}|`(?:[^`\\]|\\[\s\S])*+`|\$(?![({{'])|[@?*+!](?=\()(?<=[^\s])\((?:[^()])*+\))"
    pattern = re.compile(
        rf"(?:(?<=[\s;&|()])|^)#[^\n]*+|\\\n|[ \t\r\f\v]+|\n|\w+(?:\[[^\]\n]*+\])?\+?=\(|\[\[(?=\s)(?:[^\]\n\"']|\n|\"(?:[^\"\\]|\\[\s\S])*+\"|'[^']*+'|\](?!\]))*+\]\](?=[\s;&|)])|\(\((?:[^()]|\((?:[^()]|\([^()]*+\))*+\))*+\)\)"
        rf"|[<>]\({_nested(3)}\)|(?:\d+|\{{\w+\}})?(?:<<<|<<-?|>>|<&|>&|&>>|&>|<>|>\||<|>)|;;&|;;|;&|&&|\|\||\|&|[;&|()]|{part}++|\S"
    )
    heredoc = re.compile(r"\s*(?:'([^'\n]+)'|\"([^\"\n]+)\"|\\?([^\s;&|<>()]+))")
    special = {"\n", ";", "&", "|", "&&", "||", "|&", "(", ")", ";;", ";&", ";;&", "{", "}", "!"}

    def lex(text: str) -> tuple[list[str], list[int]]:
        kinds, places, at, waiting = [], [], 0, []
        name, words = c["NAME"], {w: k for w, k in t.items() if w.isalpha() and w != "SPACE"}
        match = pattern.match
        while at < len(text):
            m = match(text, at)
            if m is None:
                kinds.append(BAD)
                places.append(at)
                break
            token, start, at = m[0], at, m.end()
            first = token[0]
            if first in " \t\r\f\v" or first == "#" or token == "\\\n":
                continue
            if token == "\n":
                k = c["NL"]
                for mark, dashed in waiting:
                    while at < len(text):
                        end = text.find("\n", at)
                        line = text[at : end if end >= 0 else len(text)]
                        at = end + 1 if end >= 0 else len(text)
                        if (line.lstrip("\t") if dashed else line) == mark:
                            break
                waiting = []
            elif token in special:
                k = t[token]
            elif token in words:
                k = words[token]
            elif token[-1] in "<>&|" or token.endswith(("<<-", "<<<")) and re.fullmatch(r"(?:\d+|\{\w+\})?(?:<<<|<<-)", token):
                k = t["<>"]
                if re.fullmatch(r"\d*<<-?", token):
                    mark = heredoc.match(text, at)
                    if mark:
                        waiting.append((mark[1] or mark[2] or mark[3], token.endswith("-")))
            elif token[:2] == "((":
                k = t["(())"]
            elif token[:2] == "[[" and token[-2:] == "]]":
                k = t["[[]]"]
            elif token[-2:] == "=(":
                k = t["=("]
            elif token in "\"'`$\x00":
                k = BAD
            else:
                k = name if "$(" not in token or all(map(parses, _commands(token, substitution))) else BAD
            kinds.append(k)
            places.append(start)
        return kinds, places

    substitution, known = re.compile(sub), {}

    def parses(code: str) -> bool:
        """Whether the commands of a substitution parse; where brackets or marks may be text (case, heredocs, remarks), yes."""
        if re.search(r"\bcase\b|<<|#", code):
            return True
        if code not in known:
            if len(known) > 20_000:
                known.clear()
            known[code] = grammar.accepts("".join(lex(code + "\n")[0]) + END)
        return known[code]

    return Language("shell", grammar, pattern, {}, lexer=lex)


# -- JSON --------------------------------------------------------------------------------------------------------------

_JSON = """
file <- value END
value <- STR / NUM / 'true' / 'false' / 'null' / '{' (STR ':' value (',' STR ':' value)*)? '}' / '[' (value (',' value)*)? ']'
"""


def _json() -> Language:
    grammar = Grammar(_JSON, CLASSES)
    pattern = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*+"|-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?(?![\w.])|true\b|false\b|null\b|[^ \t\r\n]')
    c = grammar.kinds.of_class
    number = lambda token: c["NUM"] if len(token) > 1 or token.isdigit() else BAD
    table = {str(d): c["NUM"] for d in range(10)} | {"-": number, '"': c["STR"]}
    language = Language("json", grammar, pattern, table)
    known = grammar.kinds.of_text
    language.kind = lambda token: known.get(token) or (BAD if token == '"' else (lambda v: v(token) if callable(v) else v)(table.get(token[0], BAD)))
    return language


# -- XML ---------------------------------------------------------------------------------------------------------------

_XML = """
file <- 'decl'? 'misc'* ('doctype' 'misc'*)? element 'misc'* END
element <- 'empty' / OPEN (element / TEXT / 'misc')* CLOSE
"""


def _xml() -> Language:
    grammar = Grammar(_XML, CLASSES)
    t, c = grammar.kinds.of_text, grammar.kinds.of_class
    name = r"[^\W\d][\w.:-]*+"
    attribute = rf"\s+({name})\s*=\s*(\"[^\"<]*+\"|'[^'<]*+')"
    pattern = re.compile(
        rf"<\?xml\s[^?]*+\?>|<\?[\s\S]*?\?>|<!--(?:(?!--)[\s\S])*+-->|<!\[CDATA\[[\s\S]*?\]\]>|<!DOCTYPE(?:[^\[\]<>]|\[(?:[^\]\"']|\"[^\"]*+\"|'[^']*+')*+\])*+>"
        rf"|<({name})((?:{attribute})*+)\s*(/?)>|</({name})\s*>|[^<]+|<"
    )
    attributes = re.compile(attribute)
    reference = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[\da-fA-F]+);)")
    any_reference = re.compile(rf"&(?!(?:{name}|#\d+|#x[\da-fA-F]+);)")
    control = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")

    def lex(text: str) -> tuple[list[str], list[int]]:
        kinds, places, stack, wrong = [], [], [], reference
        for m in pattern.finditer(text):
            token = m[0]
            if token[0] != "<":
                if not token.strip(" \t\r\n"):
                    continue
                k = BAD if wrong.search(token) or "]]>" in token or control.search(token) else c["TEXT"]
            elif token[:5] == "<?xml" and token[5:6].isspace():
                k = t["decl"] if m.start() == 0 and re.match(r"<\?xml\s+version\s*=\s*[\"']1\.\d[\"']", token) else BAD
            elif token[:2] == "<?" and len(token) > 2:
                k = t["misc"]
            elif token[:4] == "<!--":
                k = t["misc"]
            elif token[:9] == "<![CDATA[":
                k = c["TEXT"]
            elif token[:9] == "<!DOCTYPE":
                k, wrong = t["doctype"], any_reference
            elif m[1]:
                names = [a[0] for a in attributes.findall(m[2])] if m[2] else ()
                if m[2] and (len(set(names)) < len(names) or wrong.search(m[2])):
                    k = BAD
                elif m[5]:
                    k = t["empty"]
                else:
                    stack.append(m[1])
                    k = c["OPEN"]
            elif m[6]:
                k = c["CLOSE"] if stack and stack.pop() == m[6] else BAD
            else:
                k = BAD
            kinds.append(k)
            places.append(m.start())
        return kinds, places

    return Language("xml", grammar, pattern, {}, lexer=lex)


# -- YAML --------------------------------------------------------------------------------------------------------------

_YAML = """
file <- 'marker'* doc ('marker'+ doc)* END
doc <- (PROP* node)?
node <- SCALAR / flow / INDENT block DEDENT / INDENT PROP+ block DEDENT
block <- ('key' PROP* node?)+ / ('-' PROP* node?)+
flow <- '[' (pair (',' pair)* ','?)? ']' / '{' (pair (',' pair)* ','?)? '}'
pair <- (PROP* item)? ':' (PROP* item)? / PROP* item
item <- SCALAR / flow
"""


def _yaml() -> Language:
    grammar = Grammar(_YAML, CLASSES, {"SCALAR": "scalar", "PROP": "prop"})
    t, c = grammar.kinds.of_text, grammar.kinds.of_class
    single, double = r"'(?:[^']|'')*+'", r'"(?:[^"\\]|\\[\s\S])*+"'
    key = re.compile(rf"(?:{single}|{double}|[^\s\-?:,\[\]{{}}#&*!|>'\"%@`\n](?:[^:#\n]|:(?=[^\s])|(?<=\S)#)*+|[-?:](?=\S)(?:[^:#\n]|:(?=[^\s])|(?<=\S)#)*+|[&*!][^\s:]++[ \t]+(?:[^:#\n\[\]{{}}\"'])*+)?[ \t]*:(?=\s|$)|<<[ \t]*:(?=\s|$)|\?(?=\s)[^\n]*+")
    flow_key = re.compile(r"[\[{][^\n\[\]{}]*+[\]}][ \t]*:(?=\s|$)")
    plain = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=\S))(?:[^:#\n]|:(?=\S)|(?<=\S)#)*+")
    flow_token = re.compile(rf"\s+|(?<=\s)#[^\n]*+|[\[\]{{}},]|{single}|{double}|:(?=[\s,\[\]{{}}])|(?<=[\"']):|[&!][^\s,\[\]{{}}]*+|\*[^\s,\[\]{{}}]++|(?:[^\s\-?:,\[\]{{}}#&*!|>'\"%@`]|[-?:](?=[^\s,\[\]{{}}]))(?:[^:#,\[\]{{}}\n]|:(?=[^\s,\[\]{{}}])|(?<=\S)#)*+|.")
    prop = re.compile(r"[&!][^\s]*+(?=\s|$)[ \t]*")
    quoted = re.compile(rf"{single}|{double}")
    scalar_head = re.compile(r"[|>](?:[-+]?[1-9]?|[1-9][-+])[ \t]*(?:#[^\n]*)?$")
    rest = re.compile(r"[ \t]*(?:[ \t]#[^\n]*)?(?=\n|$)")

    def lex(text: str) -> tuple[list[str], list[int]]:
        kinds: list[str] = []
        places: list[int] = []
        stack: list[tuple[int, str]] = []
        at, n, plain_open, bare = 0, len(text), False, True

        def put(k: str, where: int) -> None:
            kinds.append(k)
            places.append(where)

        def close(column: int, dash: bool, where: int) -> bool:
            """Dedents down to the column; False if no open block begins there."""
            popped = False
            while stack and (stack[-1][0] > column or stack[-1][0] == column and stack[-1][1] == "seq" and not dash):
                stack.pop()
                put(c["DEDENT"], where)
                popped = True
            return not popped or not stack or stack[-1][0] == column or column < 0

        control = re.search("[\x00-\x08\x0b\x0c\x0e-\x1f]", text)
        stop = control.start() if control else None
        while at < n:
            end = text.find("\n", at)
            end = n if end < 0 else end
            line = text[at:end]
            body = line.lstrip(" ")
            column = len(line) - len(body)
            if stop is not None and stop < end:
                put(BAD, stop)
                return kinds, places
            if not body.strip() or body[0] == "#" or bare and body[0] == "%" and column == 0:
                at = end + 1
                continue
            if column == 0 and re.match(r"(?:---|\.\.\.)(?:\s|$)", body):
                close(-1, False, at)
                put(t["marker"], at)
                plain_open, bare = False, body[:3] == "..."
                at += 3
                if not text[at:end].strip() or text[at:end].lstrip()[:1] == "#":
                    at = end + 1
                    continue
                column = 3 + len(text[at:end]) - len(text[at:end].lstrip())
                at = at + column - 3
            else:
                at += column
            bare = False
            if text[at] == "\t":
                stripped = text[at:end].lstrip()
                if plain_open and not key.match(stripped):
                    at = end + 1
                    continue
                put(BAD, at)
                return kinds, places
            begun = True
            while at < end:  # the parts of a line
                ch = text[at]
                found = None
                if begun:
                    dash = ch == "-" and (at + 1 >= n or text[at + 1] in " \t\n")
                    found = None if dash else key.match(text, at, end) or flow_key.match(text, at, end)
                    if plain_open and not dash and (not stack or column > stack[-1][0]) or plain_open and dash and stack and column > stack[-1][0]:
                        if found or re.search(r":(?=\s|$)(?<!\s#)", text[at:end].split(" #")[0]):
                            put(BAD, at)
                            return kinds, places
                        at = end
                        break
                    if not close(column, dash, at):
                        put(BAD, at)
                        return kinds, places
                    plain_open = False
                    if dash or found:
                        kind = "seq" if dash else "map"
                        if not stack or stack[-1][0] < column or stack[-1] == (column, "map") and dash:
                            stack.append((column, kind))
                            put(c["INDENT"], at)
                        elif stack[-1][1] != kind:
                            put(BAD, at)
                            return kinds, places
                    if dash:
                        put(t["-"], at)
                        at += 1
                        skip = len(text[at:end]) - len(text[at:end].lstrip(" \t"))
                        column += 1 + skip
                        at += skip
                        if at < end and text[at] == "#":
                            at = end
                        continue
                    if found:
                        put(t["key"], at)
                        column += found.end() - at
                        at = found.end()
                        while at < end and text[at] in " \t":
                            at += 1
                        begun = False
                        if at < end and text[at] == "#":
                            at = end
                        continue
                begun = False
                here = prop.match(text, at, end)
                if here and ch in "&!":
                    put(t["prop"], at)
                    column += here.end() - at
                    at = here.end()
                    begun = bool(key.match(text, at, end)) and kinds[-2:-1] != [t["key"]]
                    if at < end and text[at] == "#":
                        at = end
                    continue
                if ch == "#":
                    at = end
                elif ch in "|>" and scalar_head.match(text, at, end):
                    put(t["scalar"], at)
                    parent = stack[-1][0] if stack else -1
                    at = end + 1
                    while at < n:  # lines that are indented more, or empty
                        stop_at = text.find("\n", at)
                        stop_at = n if stop_at < 0 else stop_at
                        line = text[at:stop_at]
                        if line.strip(" ") and len(line) - len(line.lstrip(" ")) <= parent:
                            break
                        at = stop_at + 1
                    end = at - 1
                    at = end
                elif ch in "[{":
                    depth = 0
                    while at < n:
                        m = flow_token.match(text, at)
                        token = m[0]
                        where, at = at, m.end()
                        if token[0].isspace() or token[0] == "#" and len(token) >= 1 and where and text[where - 1].isspace():
                            if "\n" in token and stack and re.search(r"\n[ ]*$", token) and len(token) - token.rfind("\n") - 1 <= (stack[-1][0] if stack[-1][1] == "map" else stack[-1][0]) and at < n and text[at] not in "]}":
                                put(BAD, at)
                                return kinds, places
                            continue
                        if token in "[]{},:" and len(token) == 1:
                            put(t[token], where)
                            depth += (token in "[{") - (token in "]}")
                            if depth == 0:
                                break
                        elif token[0] in "&!":
                            put(t["prop"], where)
                        elif len(token) == 1 and token in "\"'#%@`|>*?" or token[0] == "*" and len(token) == 1:
                            put(BAD, where)
                            return kinds, places
                        else:
                            put(t["scalar"], where)
                    end = text.find("\n", at)
                    end = n if end < 0 else end
                    tail = rest.match(text, at)
                    if not tail:
                        put(BAD, at)
                        return kinds, places
                    at = end
                elif ch in "\"'":
                    m = quoted.match(text, at)
                    if not m:
                        put(BAD, at)
                        return kinds, places
                    put(t["scalar"], at)
                    at = m.end()
                    end = text.find("\n", at)
                    end = n if end < 0 else end
                    if not rest.match(text, at):
                        put(BAD, at)
                        return kinds, places
                    at = end
                elif ch == "*" and re.match(r"\*\S+[ \t]*(?:#|$)", text[at:end]):
                    put(t["scalar"], at)
                    at = end
                else:
                    m = plain.match(text, at, end)
                    if not m:
                        put(BAD, at)
                        return kinds, places
                    put(t["scalar"], at)
                    plain_open = True
                    at = m.end()
                    if at < end and text[at] != "#":
                        put(BAD, at)
                        return kinds, places
                    if at < end:
                        plain_open = False
                    at = end
            at = end + 1
        close(-1, False, n)
        return kinds, places

    return Language("yaml", grammar, flow_token, {}, lexer=lex)


BUILDERS: dict[str, Callable[[], Language]] = {"python": _python, "shell": _shell, "json": _json, "xml": _xml, "yaml": _yaml}
