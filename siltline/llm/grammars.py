"""Lexers and parsing-expression grammars of the languages that are judged.

Each language has ``lex(text) -> kinds`` and a grammar over the kinds. A token that no class knows becomes the kind
``?``, which no rule takes, so an unclosed string or comment or a stray character fails where it stands.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from siltline.llm.packrat import END, Grammar

CLASSES = ("NAME", "NUM", "STR", "TPL", "NL", "INDENT", "DEDENT", "DECO", "TEXT", "OPEN", "CLOSE", "EMPTY", "VAR")
BAD = "?"

_BLOCK_COMMENT = r"/\*(?:[^*]|\*(?!/))*+\*/"
_NUM = r"0[xX][\da-fA-F_]++(?:\.[\da-fA-F]*+)?(?:[pP][+-]?\d++)?[uUlLn]*+(?!\w)|0[bBoO][\d_]++[uUlLn]*+(?!\w)|(?:\d[\d_]*+(?:\.(?!\.)[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d++)?[fFdDlLuUnij]*+(?!\w)"
_NAME = r"[^\W\d][\w$]*+"
_DQ = r'"(?:[^"\\\n]|\\[\s\S])*+"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*+'"


def flat_expression(atom: str, member: str, operator: str, keyword: str = "", levels: int = 2) -> str:
    """An expression of atoms, members, calls and binary operators without rules, so that it fuses into one regular expression.

    It takes nothing that the full rule would refuse; it is tried first, with a look at what follows. With ``keyword``,
    what begins a named argument, those stand behind the others and a comma may end them.
    """
    operand = f"{atom} ({member})*"
    text = f"{operand} ({operator} {operand})*"
    for _ in range(levels):
        arguments = f"(!({keyword}) {text} (',' / &')'))* ({keyword} {text} (',' / &')'))*" if keyword else f"(({text}) (',' ({text}))*)?"
        operand = f"{atom} ({member} / '(' {arguments} ')')*"
        text = f"{operand} ({operator} {operand})*"
    return text


@dataclass
class Language:
    name: str
    grammar: Grammar
    pattern: re.Pattern
    classify: dict[str, str]
    prepare: Callable[[str], str] | None = None
    finish: Callable[[str, Grammar], str] | None = None
    lexer: Callable[[str], tuple[list[str], list[int]]] | None = None
    cache: dict[str, str] = field(default_factory=dict)

    def kinds(self, text: str) -> str:
        """The kind of each token, with END."""
        if self.lexer:
            return "".join(self.lexer(text)[0]) + END
        if self.prepare:
            text = self.prepare(text)
        get, kind = self.cache.get, self.kind
        out = "".join([get(t) or kind(t) for t in self.pattern.findall(text)])
        return (self.finish(out, self.grammar) if self.finish else out) + END

    def kind(self, token: str) -> str:
        found = self.grammar.kinds.of_text.get(token)
        if found is None:
            found = self.classify.get(token[0])
            if found is None:
                found = self.grammar.kinds.of_class["NAME"] if token[0].isalpha() or token[0] in "_$@" else BAD
            if len(token) == 1 and token[0] in "\"'`/" or token == "/*":
                found = BAD
            if callable(found):
                found = found(token)
        if len(token) < 24 and len(self.cache) < 50_000:
            self.cache[token] = found or ""
        return found or ""

    def offset(self, text: str, position: int) -> int:
        """Where in the text the token at a position of kinds begins; the text's length at END."""
        if self.lexer:
            places = self.lexer(text)[1]
            return places[position] if position < len(places) else len(text)
        prepared = self.prepare(text) if self.prepare else text
        raw, places = [], []
        for m in self.pattern.finditer(prepared):
            for k in self.kind(m[0]):
                raw.append(k)
                places.append(m.start())
        if self.finish:
            final = self.finish("".join(raw), self.grammar)
            i = 0
            kept = []
            for k in final:  # finish drops and replaces line ends only
                while i < len(raw) and raw[i] != k and raw[i] == self.grammar.kinds.of_class["NL"] and k != self.grammar.kinds.of_text.get(";", ""):
                    i += 1
                kept.append(places[i] if i < len(places) else len(text))
                i += 1
            places = kept
        return places[position] if position < len(places) else len(text)


def _class_map(grammar: Grammar, **extra: object) -> dict[str, object]:
    c = grammar.kinds.of_class
    table: dict[str, object] = {str(d): c["NUM"] for d in range(10)}
    table |= {'"': c["STR"], "'": c["STR"], "`": c["TPL"], "/": "", "\n": c["NL"], ".": c["NUM"]}
    return table | extra


# -- JavaScript and TypeScript -----------------------------------------------------------------------------------------

_JS_SETS = {
    "ID": "NAME of as from get set static async await type interface namespace module declare abstract readonly enum keyof infer is asserts public private protected override implements satisfies let unique constructor require global accessor out any unknown never string number boolean object symbol bigint",
    "BIN": "+ - * / % ** == != === !== < > <= >= << >> >>> & | ^ && || ?? instanceof in",
    "ASSIGN": "= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=",
    "PRE": "! ~ + - typeof void delete await ++ --",
    "INC": "++ --",
    "DECL": "const let var",
    "ACCESS": "public private protected static readonly abstract override declare async get set accessor",
    "LOOPNAME": "const let var",
    "SIMPLE": "NAME NUM STR this true false null",
    "FOLLOW": "; , ) ] } : NL END",
}

_JS = r"""
file <- NL* item* END
item <- import / export / stmt / NL
import <- 'import' (STR / %typeword%importnames 'from' STR / '(' assign ')' suffix* / '.' WORD suffix*) eos %importeq%
importnames <- '*' 'as' ID / names / ID (',' ('*' 'as' ID / names))?
names <- '{' (name (',' name)* ','?)? '}'
name <- %typeword%(WORD / STR) ('as' (WORD / STR))?
export <- decorator* 'export' ('default' (function / class / %interface%assign eos) / '*' ('as' (WORD / STR))? 'from' STR eos / %typeword%names ('from' STR)? eos / '=' assign eos / stmt)
eos <- ';' / NL / &'}' / &END
block <- '{' NL* stmts '}'
stmts <- (stmt / NL)*
stmt <- block / if / for / while / do / try / switch / ret / jump / %tsdecl%vardecl / function / decorator* class / ';' / 'debugger' eos / ID ':' NL* stmt / !RESERVED expr eos
if <- 'if' '(' expr ')' NL* stmt (NL* 'else' NL* stmt)?
for <- 'for' 'await'? '(' forhead ')' NL* stmt
forhead <- DECL binding ('of' assign / 'in' expr) / DECL decls? ';' expr? ';' expr? / postfix ('of' assign / 'in' expr) / expr? ';' expr? ';' expr?
while <- 'while' '(' expr ')' NL* stmt
do <- 'do' NL* stmt NL* 'while' '(' expr ')' eos?
try <- 'try' block NL* (catch NL* finally / catch / finally)
catch <- 'catch' ('(' binding ')')? block
finally <- 'finally' block
switch <- 'switch' '(' expr ')' '{' NL* (('case' expr / 'default') ':' stmts)* '}'
ret <- ('return' expr? / 'throw' expr) eos
jump <- ('break' / 'continue') ID? eos
vardecl <- DECL decls eos
decls <- decl (',' decl)*
decl <- binding ('=' assign)?
binding <- (ID / '[' (',' / '...'? pattern)* ']' / '{' (prop_pattern (',' prop_pattern)* ','?)? '}') %bang%%ann%
pattern <- (ID / '[' (',' / '...'? pattern)* ']' / '{' (prop_pattern (',' prop_pattern)* ','?)? '}') ('=' assign)?
prop_pattern <- '...' ID / key ':' pattern / ID ('=' assign)?
function <- 'async'? 'function' '*'? ID? %generic%params %retann%(block %orsig%)
params <- '(' (param (',' param)* ','?)? ')'
param <- decorator* %access%'...'? %this%(ID / '[' (',' / '...'? pattern)* ']' / '{' (prop_pattern (',' prop_pattern)* ','?)? '}') %optmark%%ann%('=' assign)?
class <- %abstract%'class' (!'extends' !'implements' ID)? %generic%('extends' postfix %typeargs%)? %implements%'{' (member / NL)* '}'
member <- ';' / 'static' block / decorator* (ACCESS !'(' !'=' !';' !':' !NL !'}')* ('*')? key %mopt%(%generic%params %retann%(block / %sigend%) / %ann%('=' assign)? eos) %indexsig%
decorator <- DECO ('.' WORD)* args? NL*
key <- WORD / STR / NUM / '[' assign ']' / '#' WORD
expr <- assign (',' assign)*
assign <- %flat% &FOLLOW / arrow / 'yield' '*'? assign? / cond (ASSIGN assign)?
arrow <- 'async'? (ID / %generic%params %retann%) '=>' (block / assign)
cond <- binary ('?' NL* assign NL* ':' assign)?
binary <- unary (BIN unary / %cast%)*
unary <- PRE* postfix
postfix <- primary suffix*
suffix <- '.' '#'? WORD / '?.' (args / '[' expr ']' / WORD) / '[' expr ']' / %callargs%args / TPL / INC / %nonnull%
args <- '(' (arg (',' arg)* ','?)? ')'
arg <- '...'? assign
primary <- function / class / ID / NUM / STR / TPL / 'this' / 'super' / 'null' / 'true' / 'false' / 'undefined' / '(' expr ')' / array / object / 'new' newtarget / 'import' (args / '.' WORD) / '#' WORD
newtarget <- '.' WORD / ('new' newtarget / function / class / ID / 'this' / '(' expr ')' / 'import') ('.' WORD / '[' expr ']')* %typeargs%args?
array <- '[' (',' / '...'? assign (',' / &']'))* ']'
object <- '{' (property (',' property)* ','?)? NL* '}'
property <- NL* ('...' assign / ('async' / 'get' / 'set')? '*'? key %generic%params %retann%block / key ':' assign / ID ('=' assign)?)
"""

_JS_ONLY = {
    "typeword": "", "importeq": "", "interface": "", "tsdecl": "", "bang": "", "ann": "", "generic": "", "retann": "", "orsig": "", "access": "", "this": "", "optmark": "", "abstract": "",
    "typeargs": "", "implements": "", "mopt": "", "sigend": "&';'&NL", "indexsig": "", "cast": "&';'&NL", "callargs": "", "nonnull": "&';'&NL",
}
_TS_ONLY = {
    "typeword": "('type' !'from' !',')? ", "importeq": "/ 'import' ID '=' expr eos", "interface": "interface / ", "tsdecl": "tsdecl / ", "bang": "'!'? ", "ann": "(':' type)? ", "generic": "generics? ",
    "retann": "(':' ('asserts'? (ID / 'this') 'is' type / type))? ", "orsig": "/ eos", "access": "ACCESS* ", "this": "('this' ':' type ','?)? ", "optmark": "'?'? ", "abstract": "'abstract'? ",
    "typeargs": "typeargs? ", "implements": "('implements' type (',' type)*)? ", "mopt": "('?' / '!')? ", "sigend": "eos", "indexsig": "/ ('readonly' / 'static')* '[' ID ':' type ']' ':' type eos",
    "cast": "('as' / 'satisfies') ('const' / type)", "callargs": "typeargs &'(' / ", "nonnull": "'!' !'='",
}
_TS_RULES = r"""
tsdecl <- interface / 'type' ID generics? '=' NL* type eos / 'const'? 'enum' ID '{' (NL / key ('=' assign)? ','?)* '}' / 'declare' (('global' / 'module' STR / 'namespace' dotted) block / stmt) / ('namespace' / 'module') (dotted / STR) '{' (NL / export / stmt)* '}'
dotted <- ID ('.' ID)*
interface <- 'interface' ID generics? ('extends' type (',' type)*)? typebody
typebody <- '{' (NL / ',' / typemember (';' / ',' / NL / &'}'))* '}'
typemember <- ('+' / '-')? ('readonly' !':' !'?' !'(')? ('new' / ('get' / 'set') &key)? (generics? params retsig? / '[' ID ('in' type ('as' type)? / ':' type) ']' (('+' / '-')? '?')? ':' type / key '?'? (generics? params retsig? / (':' type)?))
retsig <- ':' ('asserts'? (ID / 'this') 'is' type / type)
generics <- '<' generic (',' generic)* ','? '>'
generic <- 'const'? ID ('extends' type)? ('=' type)?
typeargs <- '<' type (',' type)* '>'
type <- NL* ('|' / '&')? utype (NL* ('|' / '&') NL* utype)* ('extends' utype '?' type ':' type)?
utype <- ('keyof' / 'unique' / 'readonly' / 'typeof' / 'infer')* ptype ('[' type? ']')*
ptype <- 'abstract'? 'new'? generics? params '=>' ('asserts'? (ID / 'this') 'is' type / type) / 'import' '(' STR ')' ('.' WORD)* typeargs? / (ID / 'void' / 'null' / 'undefined' / 'this' / 'true' / 'false') ('.' WORD)* typeargs? / STR / '-'? NUM / TPL / typebody / '[' ('...'? (ID '?'? ':')? type '?'? (',' / &']'))* ']' / '(' type ')'
"""
_JS_RESERVED = "if else for while do try catch finally switch case default return throw break continue const var class extends"


def _fill(text: str, parts: dict[str, str]) -> str:
    return re.sub(r"%(\w+)%", lambda m: parts[m[1]], text)


def _js_finish(kinds: str, g: Grammar) -> str:
    rx = g.__dict__.get("line_ends")
    if rx is None:
        nl, t = g.kinds.of_class["NL"], g.kinds.of_text
        before = "".join(t[x] for x in "{ ( [ , ; : ? => = + * / % & | && || ?? == === != !== < <= >= . ?. ! ~ += -= ...".split() if x in t)
        after = "".join(t[x] for x in "{ ) ] , ; : ? => = * % & && | || ?? == === != !== <= >= . ?. += -= else catch finally instanceof in".split() if x in t)
        rx = g.line_ends = re.compile(f"(?<=[{''.join(map(re.escape, before))}]){nl}+|{nl}+(?=[{''.join(map(re.escape, after))}])|{nl}+(?={nl})")
    return rx.sub("", kinds)


def _javascript(name: str, parts: dict[str, str], more: str) -> Language:
    flat = flat_expression("SIMPLE", "'.' WORD", "BIN")
    grammar = Grammar(_fill(_JS, parts | {"flat": flat}) + more, CLASSES, _JS_SETS | {"RESERVED": _JS_RESERVED})
    regex_literal = r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"
    pattern = re.compile(
        rf"//[^\n]*+|{_BLOCK_COMMENT}|/\*|{_NAME}|\$[\w$]*+|\n[\s]*+|{_DQ}|{_SQ}|`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{(?:[^{{}}`]|`[^`]*+`|\{{[^{{}}]*+\}})*+\}})*+`|{_NUM}|@{_NAME}"
        rf"|(?:\?\?|&&|\|\||=>|[=!<>]==?|[(,=:\[!&|?{{;+\-*%<>~^])\s*{regex_literal}"
        r"|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|\S"
    )
    c, t = grammar.kinds.of_class, grammar.kinds.of_text

    def operator_then_regex(token: str) -> str:
        op = re.match(r"\?\?|&&|\|\||=>|[=!<>]==?|.", token)[0]
        return t.get(op, BAD) + c["STR"] if len(token) > len(op) else BAD

    def template(token: str) -> str:
        return c["TPL"] if "${" not in token or all(map(substitution, _substitutions(token))) else BAD

    def substitution(text: str) -> bool:
        if _PLAIN_SUBSTITUTION.fullmatch(text):
            return True
        parses = lambda code: language.grammar.accepts(language.kinds(code))
        return bool(text.strip()) and (parses(f"({text})") or name == "typescript" and parses(f"type X = {text}"))

    classify = _class_map(grammar, **{"@": c["DECO"], "`": template}) | {ch: operator_then_regex for ch in "(,=:[!&|?{;+-*%<>~^"}
    text_of = lambda text: re.sub(r"^#![^\n]*", "", text)
    language = Language(name, grammar, pattern, classify, text_of, _js_finish)
    return language


_PLAIN_SUBSTITUTION = re.compile(r"\s*(?!(?:if|for|in|let|const|var|return|class|new|typeof|do|else|while)\b)[A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+|\[[\w$]+\]|\(\))*+\s*")
_SUBSTITUTION_PART = re.compile(r"`(?:[^`\\]|\\[\s\S])*+`|" + _DQ + "|" + _SQ + r"|//[^\n]*+|/\*[\s\S]*?\*/|[{}/]")


def _substitutions(token: str) -> list[str]:
    """The code between ``${`` and its brace, for each in a template; what holds a slash (it may begin a pattern) isn't judged."""
    out, at = [], 1
    while True:
        sign = re.compile(r"\\[\s\S]|\$\{").search(token, at)
        if sign is None:
            return out
        at = sign.end()
        if sign[0] != "${":
            continue
        begin, depth, plain = at, 0, True
        while True:
            part = _SUBSTITUTION_PART.search(token, at)
            if part is None:
                return out
            at = part.end()
            plain &= part[0] != "/"
            if part[0] == "{":
                depth += 1
            elif part[0] == "}":
                if not depth:
                    break
                depth -= 1
        if plain:
            out.append(token[begin : at - 1])


# -- Java --------------------------------------------------------------------------------------------------------------

_JAVA = r"""
file <- (annotation* 'package' qname ';')? (import / ';')* (typedecl / ';')* END
import <- 'import' 'static'? qname ('.' '*')? ';'
qname <- ID ('.' ID)*
annotation <- DECO ('.' ID)* ('(' (annarg (',' annarg)*)? ')')?
annarg <- ID '=' annvalue / annvalue
annvalue <- annotation / '{' (annvalue (',' annvalue)*)? ','? '}' / cond
mods <- (annotation / MOD / 'default' !':' !'->' / 'sealed' / 'non' '-' 'sealed')*
typedecl <- mods (class / interface / enum / record / atinterface)
class <- 'class' ID generics? ('extends' type)? ('implements' types)? ('permits' types)? body
interface <- 'interface' ID generics? ('extends' types)? ('permits' types)? body
atinterface <- ATINTERFACE ID body
record <- 'record' ID generics? params ('implements' types)? body
enum <- 'enum' ID ('implements' types)? '{' (constant (',' constant)*)? ','? (';' member*)? '}'
constant <- annotation* ID args? body?
types <- type (',' type)*
body <- '{' member* '}'
member <- ';' / 'static'? block / typedecl / mods (generics? (ID params throws? block / ID block / (type / 'void') ID params dims throws? (block / ('default' annvalue)? ';')) / type declarators ';')
throws <- 'throws' types
params <- '(' (param (',' param)*)? ')'
param <- mods type annotation* '...'? ('this' / ID ('.' 'this')?) dims
generics <- '<' generic (',' generic)* '>'
generic <- annotation* ID ('extends' type ('&' type)*)?
type <- annotation* (PRIM / ID typeargs? ('.' annotation* ID typeargs?)*) dims
dims <- (annotation* '[' ']')*
typeargs <- '<' (typearg (',' typearg)*)? '>'
typearg <- annotation* '?' (('extends' / 'super') type)? / type
block <- '{' stmt* '}'
stmt <- block / ';' / if / for / while / do / try / switch / sync / ret / jump / 'assert' expr (':' expr)? ';' / 'yield' expr ';' / ID ':' stmt / typedecl / local ';' / expr ';'
local <- mods type declarators
declarators <- declarator (',' declarator)*
declarator <- ID dims ('=' (arrayinit / expr))?
arrayinit <- '{' (initval (',' initval)*)? ','? '}'
initval <- arrayinit / expr
if <- 'if' '(' expr ')' stmt ('else' stmt)?
for <- 'for' '(' (mods type ID ':' expr / (local / expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)?) ')' stmt
while <- 'while' '(' expr ')' stmt
do <- 'do' stmt 'while' '(' expr ')' ';'
try <- 'try' (resources block catch* finally? / block (catch+ finally? / finally))
resources <- '(' (local / expr) (';' (local / expr))* ';'? ')'
catch <- 'catch' '(' mods type ('|' type)* ID ')' block
finally <- 'finally' block
switch <- 'switch' '(' expr ')' '{' (label+ (('->' (block / 'throw' expr ';' / expr ';')) / stmt*))* '}'
label <- 'case' pattern (',' pattern)* ('when' expr)? (':' / &'->') / 'default' (':' / &'->')
pattern <- 'default' / mods type ID / mods type '(' (pattern (',' pattern)*)? ')' / cond
sync <- 'synchronized' '(' expr ')' block
ret <- ('return' expr? / 'throw' expr) ';'
jump <- ('break' / 'continue') ID? ';'
expr <- %flat% &FOLLOW / lambda / cond (ASSIGN expr)?
lambda <- (ID / '(' (ID (',' ID)*)? ')' / params) '->' (block / expr)
cond <- binary ('?' expr ':' (lambda / expr))?
binary <- unary (BIN unary / '>' '>' '>'? unary / 'instanceof' (mods type ID? / pattern))*
unary <- PRE unary / cast / postfix
cast <- '(' type ('&' type)* ')' (lambda / CASTABLE unary / &PRIMLIT postfix) / '(' PRIM dims ')' unary
CASTABLE_RULE <- 'this'
postfix <- primary suffix*
suffix <- '.' (typeargs? ID args? / 'this' / 'class' / 'new' creator / 'super' args?) / '[' expr ']' / '::' typeargs? (ID / 'new') / '++' / '--'
args <- '(' (expr (',' expr)*)? ')'
primary <- 'new' creator / type '::' (ID / 'new') / type '.' 'class' / (PRIM / 'void') dims '.' 'class' / 'switch' '(' expr ')' &'{' switchbody / ID args? / NUM / STR / 'true' / 'false' / 'null' / ('this' / 'super') args? / '(' expr ')'
switchbody <- '{' (label+ (('->' (block / 'throw' expr ';' / expr ';')) / stmt*))* '}'
creator <- annotation* (PRIM / ID typeargs? ('.' ID typeargs?)*) (args body? / ('[' expr? ']')+ arrayinit?)
"""
_JAVA_SETS = {
    "ID": "NAME record sealed permits when yield var module open with to",
    "MOD": "public private protected static final abstract native synchronized transient volatile strictfp",
    "PRIM": "int long short byte char boolean float double",
    "ASSIGN": "= += -= *= /= %= &= |= ^= <<= >>= >>>=",
    "BIN": "+ - * / % == != < > <= >= && || & | ^ <<",
    "PRE": "! ~ + - ++ --",
    "CASTABLE": "&nothing",
    "PRIMLIT": "NAME NUM STR this super new true false null ( ! ~ int long short byte char boolean float double record var when with to open module sealed permits switch",
    "ATINTERFACE": "@interface",
    "SIMPLE": "NAME NUM STR this true false null",
    "FOLLOW": "; , ) ] } :",
}


def _java() -> Language:
    rules = _JAVA.replace("CASTABLE unary / ", "").replace("CASTABLE_RULE <- 'this'\n", "")
    sets = {k: v for k, v in _JAVA_SETS.items() if k != "CASTABLE"}
    rules = _fill(rules, {"flat": flat_expression("SIMPLE", "'.' NAME", "BIN")})
    grammar = Grammar(rules, CLASSES, sets)
    pattern = re.compile(
        rf'//[^\n]*+|{_BLOCK_COMMENT}|/\*|{_NAME}|"""[\s\S]*?(?<!\\)"""|{_DQ}|{_SQ}|{_NUM}|@interface\b|@{_NAME}'
        r"|\.\.\.|->|::|<<=|>>>=|>>=|<<|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\S"
    )
    return Language("java", grammar, pattern, _class_map(grammar, **{"@": grammar.kinds.of_class["DECO"]}))


# -- Go ----------------------------------------------------------------------------------------------------------------

_GO = r"""
file <- ';'* 'package' NAME ';' (import ';')* (top ';')* END
import <- 'import' (spec / '(' (spec ';')* spec? ')')
spec <- ('.' / NAME)? STR
top <- func / decl
decl <- ('const' / 'var') (varspec / '(' (varspec ';')* varspec? ')') / 'type' (typespec / '(' (typespec ';')* typespec? ')')
varspec <- names type? ('=' exprs)?
typespec <- NAME (generics / &'[' &NAME)? '='? type / NAME type
names <- NAME (',' NAME)*
generics <- '[' names constraint (',' names constraint)* ','? ']'
constraint <- cterm ('|' cterm)*
cterm <- '~'? type
func <- 'func' receiver? NAME generics? signature block?
receiver <- params
signature <- params (params / type)?
params <- '(' (param (',' param)* ','?)? ')'
param <- NAME '...'? type / '...'? type
type <- '*' type / '[' (expr / '...')? ']' type / 'map' '[' type ']' type / '<-' 'chan' type / 'chan' '<-'? type / 'func' signature / 'struct' fields / 'interface' methods / '(' type ')' / NAME ('.' NAME)? ('[' type (',' type)* ']')?
fields <- '{' (field ';')* field? '}'
field <- (names type / '*'? NAME ('.' NAME)? typeargs?) STR?
typeargs <- '[' type (',' type)* ']'
methods <- '{' (method ';')* method? '}'
method <- NAME signature / constraint
block <- '{' stmts '}'
stmts <- (stmt? ';')* stmt?
stmt <- decl / block / if / for / switch / select / ('go' / 'defer') expr / 'return' exprs? / ('break' / 'continue' / 'goto') NAME? / 'fallthrough' / NAME ':' stmt? / simple
simple <- exprs (':=' exprs / ASSIGN exprs / '++' / '--' / '<-' expr)?
cheader <- (csimple? ';')? (csimple)?
csimple <- cexprs (':=' cexprs / ASSIGN cexprs / '++' / '--' / '<-' cexpr)?
if <- 'if' (csimple? ';')? cexpr block ('else' (if / block))?
for <- 'for' (block / (cexprs (':=' / '='))? 'range' cexpr block / csimple? ';' cexpr? ';' csimple? block / cexpr block)
switch <- 'switch' cheader '{' (('case' (exprs / types) / 'default') ':' stmts)* '}' / 'switch' (csimple ';')? (NAME ':=')? cpostfix '.' '(' 'type' ')' '{' (('case' types / 'default') ':' stmts)* '}'
types <- type (',' type)*
select <- 'select' '{' (('case' simple / 'default') ':' stmts)* '}'
exprs <- expr (',' expr)*
expr <- %flat% &FOLLOW / unary (BIN unary)*
unary <- PRE unary / postfix
postfix <- primary suffix*
suffix <- '.' (NAME / '(' (type / 'type') ')') / '[' (expr? ':' expr? (':' expr)? / type (',' type)* ','? / expr) ']' / args / literal
args <- '(' (arg (',' arg)* '...'? ','?)? ')'
arg <- expr / type
primary <- 'func' signature block / complit / NAME / NUM / STR / TPL / '(' (expr / type) ')' / conversion
complit <- ('[' (expr / '...')? ']' type / 'map' '[' type ']' type / 'struct' fields) literal
conversion <- ('[' expr? ']' type / 'map' '[' type ']' type / 'chan' type / 'interface' methods) args
literal <- '{' (element (',' element)* ','?)? '}'
element <- (literal / expr) (':' (literal / expr))?
cexprs <- cexpr (',' cexpr)*
cexpr <- %flat% &CFOLLOW / cunary (BIN cunary)*
cunary <- PRE cunary / cpostfix
cpostfix <- primary csuffix*
csuffix <- !('.' '(' 'type' ')') '.' (NAME / '(' type ')') / '[' (expr? ':' expr? (':' expr)? / expr) ']' / args
"""
_GO_SETS = {
    "ASSIGN": "= += -= *= /= %= &= |= ^= <<= >>= &^=",
    "BIN": "+ - * / % == != < > <= >= && || & | ^ << >> &^",
    "PRE": "+ - ! ^ * & <- ~",
    "SIMPLE": "NAME NUM STR",
    "FOLLOW": "; , ) ] } :",
    "CFOLLOW": "{ ;",
}


def _go_finish(kinds: str, g: Grammar) -> str:
    rx = g.__dict__.get("line_ends")
    if rx is None:
        c, t = g.kinds.of_class, g.kinds.of_text
        ends = c["NAME"] + c["NUM"] + c["STR"] + c["TPL"] + "".join(t[x] for x in ") ] } ++ -- return break continue fallthrough".split())
        g.line_ends = rx = (re.compile(f"(?<=[{re.escape(ends)}]){c['NL']}+"), re.compile(c["NL"]), t[";"])
    with_marks = rx[0].sub(rx[2], kinds + c_nl(g))
    return rx[1].sub("", with_marks)


def c_nl(g: Grammar) -> str:
    return g.kinds.of_class["NL"]


def _go() -> Language:
    grammar = Grammar(_fill(_GO, {"flat": flat_expression("SIMPLE", "'.' NAME", "BIN")}), CLASSES, _GO_SETS)
    pattern = re.compile(
        rf"//[^\n]*+|{_BLOCK_COMMENT}|/\*|{_NAME}|\n[\s]*+|{_DQ}|{_SQ}|`[^`]*+`|{_NUM}"
        r"|\.\.\.|<<=|>>=|&\^=|&\^|<-|:=|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\S"
    )
    table = _class_map(grammar)
    table["`"] = grammar.kinds.of_class["STR"]
    return Language("go", grammar, pattern, table, None, _go_finish)


# -- C -----------------------------------------------------------------------------------------------------------------

_C = r"""
file <- top* END
top <- ';' / 'extern' STR ('{' top* '}' / top) / funcdef / declaration / NAME '(' (macroarg (',' macroarg)*)? ')' ';'?
macroarg <- expr / type
funcdef <- attr* specs declarator olddecl* block
olddecl <- declaration
declaration <- attr* 'typedef'? specs (initdecl (',' initdecl)*)? attr* ';' / '_Static_assert' args ';'
initdecl <- declarator (':' cond)? attr* ('=' init)?
attr <- ATTR '(' '(' attrtok* ')' ')' / ATTR '(' attrtok* ')'
attrtok <- '(' attrtok* ')' / !'(' !')' ANY
specs <- qual* (struct / enum / BASE (BASE / qual)* / NAME !'=' !'+' !'-' !'[' !'.') qual*
qual <- QUAL / attr / ('_Alignas' / '__typeof__' / 'typeof') '(' (type / expr) ')'
struct <- ('struct' / 'union') attr* NAME? '{' field* '}' attr* / ('struct' / 'union') attr* NAME
field <- ';' / specs ((declarator? (':' cond)?) (',' declarator? (':' cond)?)*)? attr* ';' / '_Static_assert' args ';'
enum <- 'enum' (NAME? '{' NAME ('=' cond)? (',' NAME ('=' cond)?)* ','? '}' / NAME)
declarator <- ('*' qual*)* (NAME / '(' attr* declarator ')') (params / '[' ('static' / qual)* assign? ']')* attr*
params <- '(' (param (',' param)* (',' '...')? / '...' / NAME (',' NAME)*)? ')'
param <- specs (declarator / abstract)? attr*
abstract <- ('*' qual*)+ absuffix* / absuffix+
absuffix <- '(' abstract ')' / params / '[' assign? ']'
type <- specs abstract?
init <- '{' (initelem (',' initelem)*)? ','? '}' / assign
initelem <- (('.' NAME / '[' cond ('...' cond)? ']')+ '=')? init
block <- '{' (stmt / declaration)* '}'
stmt <- block / ';' / 'if' '(' expr ')' body ('else' body)? / 'while' '(' expr ')' body / 'do' body 'while' '(' expr ')' ';' / 'for' '(' (declaration / expr? ';') expr? ';' expr? ')' body / 'switch' '(' expr ')' body / 'case' cond ('...' cond)? ':' stmt? / 'default' ':' stmt? / 'return' expr? ';' / 'break' ';' / 'continue' ';' / 'goto' NAME ';' / NAME ':' (stmt / &'}') / asm / declaration / expr ';'
body <- stmt
asm <- ASM QUAL* '(' attrtok* ')' ';'
expr <- assign (',' assign)*
assign <- %flat% &FOLLOW / cond (ASSIGN assign)?
cond <- binary ('?' expr? ':' cond)?
binary <- unary (BIN unary)*
unary <- ('++' / '--') unary / PRE unary / ('sizeof' / '_Alignof') ('(' type ')' !'{' / unary) / '(' type ')' ('{' (initelem (',' initelem)*)? ','? '}' suffix* / unary) / postfix
postfix <- primary suffix*
suffix <- '[' expr ']' / args / '.' NAME / '->' NAME / '++' / '--'
args <- '(' ((assign / type) (',' (assign / type))*)? ')'
primary <- NAME / NUM / STR+ (NAME STR*)* / '(' block ')' / '(' expr ')'
"""
_C_SETS = {
    "BASE": "void char short int long float double signed unsigned _Bool _Complex",
    "QUAL": "const volatile static extern inline register restrict auto _Noreturn _Thread_local _Atomic __inline __restrict __extension__ __inline__ __volatile__",
    "ATTR": "__attribute__ __declspec",
    "ASM": "asm __asm__ __asm",
    "ASSIGN": "= += -= *= /= %= &= |= ^= <<= >>=",
    "BIN": "+ - * / % == != < > <= >= && || & | ^ << >>",
    "PRE": "& * + - ~ !",
    "SIMPLE": "NAME NUM STR",
    "FOLLOW": "; , ) ] } :",
}


def _c_directives(text: str) -> str:
    return re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\(?:\r?\n|.))*", lambda m: "\n" * m[0].count("\n"), text)


def _c() -> Language:
    grammar = Grammar(_fill(_C, {"flat": flat_expression("SIMPLE", "'.' NAME / '->' NAME", "BIN")}), CLASSES, _C_SETS)
    pattern = re.compile(
        rf'#(?:[^\n\\/]|/(?!\*)|\\\n|\\.)*+|//[^\n]*+|{_BLOCK_COMMENT}|/\*|(?:u8|[uUL])(?=["\'])|{_NAME}|{_DQ}|{_SQ}|{_NUM}'
        r"|\.\.\.|->|<<=|>>=|<<|>>|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\S"
    )
    table = _class_map(grammar) | {"#": lambda token: "" if re.match(r"#\s*(?:\w|$|!)", token) else BAD}
    return Language("c", grammar, pattern, table)


# -- PHP ---------------------------------------------------------------------------------------------------------------

_PHP = r"""
file <- TEXT? (OPEN (top)* (CLOSE TEXT?)?)* END
eos <- ';' / CLOSE TEXT? (OPEN / &END) / &END_OF_CODE
top <- namespace / use / constdecl / stmt
namespace <- 'namespace' (qname ('{' top* '}' / eos) / '{' top* '}')
use <- 'use' ('function' / 'const')? usename (',' usename)* eos
usename <- qname ('as' ID / '\\' '{' usename (',' usename)* ','? '}')?
qname <- 'namespace'? '\\'? WORD ('\\' WORD)*
constdecl <- 'const' WORD '=' expr (',' WORD '=' expr)* eos
block <- '{' top* '}'
stmt <- block / ';' / CLOSE TEXT? OPEN / CLOSE TEXT? &END / if / while / 'do' stmt 'while' '(' expr ')' eos / for / foreach / switch / try / 'return' expr? eos / ('break' / 'continue') NUM? eos / 'echo' expr (',' expr)* eos / 'global' VAR (',' VAR)* eos / 'static' VAR ('=' expr)? (',' VAR ('=' expr)?)* eos / 'unset' args eos / 'declare' args (stmt / eos) / 'goto' ID eos / attrs? (function / class) / NAME ':' !':' / expr eos
if <- 'if' '(' expr ')' (':' top* ('elseif' '(' expr ')' ':' top*)* ('else' ':' top*)? 'endif' eos / stmt (('elseif' / 'else' 'if') '(' expr ')' stmt)* ('else' stmt)?)
while <- 'while' '(' expr ')' (':' top* 'endwhile' eos / stmt)
for <- 'for' '(' exprs? ';' exprs? ';' exprs? ')' (':' top* 'endfor' eos / stmt)
foreach <- 'foreach' '(' expr 'as' ('&'? expr '=>')? '&'? expr ')' (':' top* 'endforeach' eos / stmt)
switch <- 'switch' '(' expr ')' ('{' cases '}' / ':' cases 'endswitch' eos)
cases <- (('case' expr / 'default') (':' / ';') top*)*
try <- 'try' block (catch+ finally? / finally)
catch <- 'catch' '(' type VAR? ')' block
finally <- 'finally' block
attrs <- (ATTR expr (',' expr)* ','? ']')+
function <- 'function' '&'? WORD params ret? block
ret <- ':' type
type <- '?'? ptype (('|' / '&' !VAR !'...' !'&') ptype)*
ptype <- qname / '(' type ')'
params <- '(' (param (',' param)* ','?)? ')'
param <- attrs? MOD* type? '&'? '...'? VAR ('=' expr)?
class <- MOD* ('class' / 'interface' / 'trait' / 'enum') ID (':' type)? ('extends' qname (',' qname)*)? ('implements' qname (',' qname)*)? body
body <- '{' member* '}'
member <- attrs? ('use' qname (',' qname)* (';' / '{' traitrule* '}') / 'case' WORD ('=' expr)? ';' / MOD* 'const' (type &(WORD '='))? WORD '=' expr (',' WORD '=' expr)* ';' / MOD* 'function' '&'? WORD params ret? (block / ';') / (MOD / 'var')+ type? VAR ('=' expr)? (',' VAR ('=' expr)?)* ';')
traitrule <- qname ('::' WORD)? ('as' MOD? WORD? / 'insteadof' qname (',' qname)*) ';'
exprs <- expr (',' expr)*
expr <- %flat% &FOLLOW / ('print' / 'yield' 'from' / 'throw' / 'include' / 'include_once' / 'require' / 'require_once') expr / 'yield' (expr ('=>' expr)?)? / assign
assign <- unary (BIN unary / ASSIGN '&'? expr / '?' expr? ':' unary / 'instanceof' unary)*
unary <- PRE unary / CAST unary / 'new' new suffix* / 'clone' unary / postfix
new <- attrs? 'class' args? ('extends' qname)? ('implements' qname (',' qname)*)? body / ('static' / qname / VAR (('->' / '::') (WORD / VAR))* / '(' expr ')') args?
postfix <- primary suffix*
suffix <- '[' expr? ']' / '{' expr '}' / ('->' / '?->') (WORD / VAR / '{' expr '}') / '::' (WORD / VAR / '{' expr '}') / args / '++' / '--'
args <- '(' (arg (',' arg)* ','?)? ')'
arg <- '...' (expr / &')') / WORD ':' !':' expr / '&'? expr
primary <- closure / VAR / NUM / STR+ / 'array' array_args / 'list' array_args / '[' (elem? (',' elem?)*) ']' / ('isset' / 'empty' / 'exit' / 'die' / 'eval') args? / 'match' '(' expr ')' '{' (match (',' match)* ','?)? '}' / '(' expr ')' / 'static' / !STOP qname
array_args <- '(' (elem? (',' elem?)*) ')'
elem <- '...' expr / '&'? expr ('=>' '&'? expr)?
match <- ('default' / exprs) ','? '=>' expr
closure <- attrs? 'static'? ('function' '&'? params ('use' '(' ('&'? VAR (',' '&'? VAR)* ','?)? ')')? ret? block / 'fn' '&'? params ret? '=>' expr)
"""
_PHP_SETS = {
    "ID": "NAME enum",
    "MOD": "public private protected static final abstract readonly",
    "ASSIGN": "= += -= *= /= .= %= **= &= |= ^= <<= >>= ??=",
    "BIN": "+ - * / % . ** == != === !== < > <= >= <=> <> << >> & | ^ && || ?? and or xor",
    "PRE": "! ~ + - @ ++ -- &",
    "CAST": "(cast)",
    "ATTR": "#[",
    "END_OF_CODE": "CLOSE",
    "STOP": "endif endwhile endfor endforeach endswitch else elseif case default catch finally as if while for foreach switch do try return break continue echo function class interface trait use const global unset instanceof",
    "SIMPLE": "NAME VAR NUM STR",
    "FOLLOW": "; , ) ] } CLOSE =>",
}


def _php_lexer(language_box: list) -> Callable[[str], tuple[list[str], list[int]]]:
    pattern = re.compile(
        rf"\?>\n?|#\[|(?://|#)(?:[^\n?]|\?(?!>))*+|{_BLOCK_COMMENT}|/\*|\$+{_NAME}|\$(?=\{{)|{_NAME}|<<<[ \t]*(['\"]?)({_NAME})\1\n[\s\S]*?\n?[ \t]*\b\2\b"
        rf'|"(?:[^"\\]|\\[\s\S])*+"|\'(?:[^\'\\]|\\[\s\S])*+\'|`[^`]*+`|{_NUM}|\(\s*(?:int|integer|float|double|string|bool|boolean|array|object|unset|binary)\s*\)'
        r"|\.\.\.|<=>|===|!==|\*\*=|<<=|>>=|\?\?=|\?->|->|=>|::|==|!=|<>|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|\*\*|<<|>>|\S",
        re.IGNORECASE,
    )
    opener = re.compile(r"<\?(?:php\b|=)", re.IGNORECASE)

    def lex(text: str) -> tuple[list[str], list[int]]:
        language = language_box[0]
        c, t = language.grammar.kinds.of_class, language.grammar.kinds.of_text
        kinds, places, at = [], [], 0
        get, kind, cast = language.cache.get, language.kind, t["(cast)"]
        while at < len(text):
            start = opener.search(text, at)
            if start is None or start.start() > at:
                kinds.append(c["TEXT"])
                places.append(at)
            if start is None:
                break
            kinds.append(c["OPEN"])
            places.append(start.start())
            if start[0] == "<?=":
                kinds.append(t["echo"])
                places.append(start.start())
            at = start.end()
            for m in pattern.finditer(text, at):
                token = m[0]
                if token[:2] == "?>":
                    kinds.append(c["CLOSE"])
                    places.append(m.start())
                    at = m.end()
                    break
                k = get(token)
                if k is None:
                    if token[0] == "(" and len(token) > 1:
                        k = cast
                    elif token[:3] == "<<<":
                        k = c["STR"] if m[2] else BAD
                    else:
                        k = kind(token if token in t or not token[0].isalpha() else token.lower() if token.lower() in t else token)
                if k:
                    kinds.append(k)
                    places.append(m.start())
            else:
                break
        return kinds, places

    return lex


def _php() -> Language:
    grammar = Grammar(_fill(_PHP, {"flat": flat_expression("SIMPLE", "'->' NAME / '[' SIMPLE ']'", "BIN")}), CLASSES, _PHP_SETS)
    box: list[Language] = []
    table = _class_map(grammar)
    c = grammar.kinds.of_class
    table |= {"$": lambda token: c["VAR"] if len(token) > 1 else BAD, "#": "", "`": c["STR"]}
    language = Language("php", grammar, re.compile("."), table, lexer=_php_lexer(box))
    box.append(language)
    return language
