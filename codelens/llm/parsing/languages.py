"""Token classes, brackets and grammars of the supported languages.

Token classes: i name (contextual keywords too), C name of a type declared in the file, n number, s string or character, b binary
operator of several characters, a compound assignment, p ++ or --, r ->, k =>, c ::, d :=, v ..., q ?. ; other operators
stand for themselves. Dialects (script and module, old and new styles, typed and untyped) are alternatives and start symbols of
one grammar, so one run follows them all.
"""

from __future__ import annotations

#: Operators of several characters and their token classes.
C_OPERATORS = {"==": "b", "!=": "b", "<=": "b", "&&": "b", "||": "b", "<<": "b", "+=": "a", "-=": "a", "*=": "a", "/=": "a", "%=": "a", "&=": "a", "|=": "a", "^=": "a", "<<=": "a", "++": "p", "--": "p", "->": "r", "::": "c", "...": "v", "=>": "k"}
JS_OPERATORS = C_OPERATORS | {"===": "b", "!==": "b", "**": "b", "??": "b", "?.": "q", "**=": "a", "??=": "a", "&&=": "a", "||=": "a"}
PY_OPERATORS = {"==": "b", "!=": "b", "<=": "b", ">=": "b", "<<": "b", ">>": "b", "**": "x", "//": "b", "+=": "a", "-=": "a", "*=": "a", "/=": "a", "%=": "a", "&=": "a", "|=": "a", "^=": "a", "@=": "a", "//=": "a", "**=": "a", ">>=": "a", "<<=": "a", "->": "r", ":=": "d", "...": "v"}
GO_OPERATORS = C_OPERATORS | {":=": "d", "<-": "w", ">=": "b", ">>": "b", ">>=": "a", "&^": "b", "&^=": "a"}
RUST_OPERATORS = C_OPERATORS | {"..=": "v", "..": "v", "||": "o"}
RUBY_OPERATORS = {"==": "b", "===": "b", "!=": "b", "<=": "b", ">=": "b", "<=>": "b", "&&": "b", "||": "o", "<<": "b", ">>": "b", "**": "x", "=~": "b", "!~": "b", "+=": "a", "-=": "a", "*=": "a", "/=": "a", "||=": "a", "&&=": "a", "<<=": "a", ">>=": "a", "|=": "a", "&=": "a", "^=": "a", "%=": "a", "**=": "a", "=>": "k", "->": "r", "::": "c", "..": "v", "...": "v", "&.": "q"}

BLOCK_COMMENT = r"/\*[\s\S]*?\*/"
LINE_COMMENT = r"//[^\n]*"
DQ, SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
NUMBER = r"(?:0[xXbBoO][0-9a-fA-F_']+|(?:\d[\d_']*)?\.?\d[\d_]*(?:\.(?!\.))?(?:[eEpP][+-]?\d+)?)[a-zA-Z0-9_]*"
NAME = r"[^\W\d]\w*"
BRACES = "\U000f8000-\U000fffff"

#: Of each language: reserved and contextual keywords, operators, lexer, roles of the contents of each bracket, start symbols,
#: islands and the tokens at which they may end, grammar.
LANGUAGES: dict[str, dict] = {}

LANGUAGES["c"] = {
    "keywords": "if else for while do switch case default return break continue goto typedef struct union enum sizeof static extern const volatile inline register unsigned signed restrict int char float double long short void auto bool _Generic".split(),
    "contextual": [],
    "operators": C_OPERATORS,
    "names": rf"(?!(?:u8|[uUL])[\"'])(?:{NAME})",
    "lexer": rf"{BLOCK_COMMENT}|//(?:[^\n\\]|\\[\s\S])*|^[ \t]*#[ \t]*(?:include|define|undef|if|ifdef|ifndef|else|elif|elifdef|elifndef|endif|line|pragma|error|warning|embed)\b(?:[^\n\\]|\\[\s\S])*|(?:u8|[uUL])?{DQ}|[uUL]?{SQ}|{NAME}|{NUMBER}",
    "(": {"ARGS": "Args", "PARAMS": "Params", "NAMES": "Names", "FOR": "For", "TYPE": "TypeName", "GENERIC": "Generic", "COMPOUND": "Compound"},
    "[": {"INDEX": "Index", "ATTRIN": "Tree"},
    "{": {"BLOCK": "Stmts", "FIELDS": "Fields", "INIT": "Init", "ENUM": "Enum", "TOP": "Unit"},
    "starts": ("Unit",),
    "islands": ("Stmt", "Top", "Field"),
    "stops": ";" + BRACES,
    "grammar": """
E: Cond | U AsgOp E | U AsgOp <INIT>
Cond: Bx | Bx '?' E ':' Cond | Bx '?' ':' Cond
Bx: U | Bx Bin U
AsgOp: '=' | a | '>' '>' '='
Bin: '+-*/%&|^<>' | b | '>' '>' | '>' '='
U: P | Pre U | <TYPE> U | sizeof <TYPE> | sizeof U
Pre: '+-*&!~' | p | b
P: i | n | Str | <ARGS> | <COMPOUND> | <TYPE> <INIT> | _Generic <GENERIC> | P <ARGS> | P <INDEX> | P '.' i | P r i | P p
Str: s | s Str | i Str | s i
Compound: <BLOCK>
Generic: E ',' Assocs
Assocs: Assoc | Assoc ',' Assocs
Assoc: TypeName ':' E | default ':' E
Args: | Arg | Arg ',' Args1
Args1: Arg | Arg ',' Args1
Arg: Comma1 | TypeName | <BLOCK>
Comma1: E
Index: | E | static E | Qual* | Qual+ E | '*'
Base: int | char | float | double | long | short | void | unsigned | signed | bool | Base Base
Qual: const | volatile | static | extern | inline | register | restrict | auto | i <ARGS> | Attr
Attr: '[' | <ATTR>
Tag: struct | union | enum
Type: Qual* Core Qual*
Core: Base | i | i <ARGS> | Tag Qual* i | Tag Qual* i? <FIELDS> | enum Qual* i? <ENUM> | enum i ':' Type <ENUM>
TypeName: Type Abs
Abs: | '*' Qual* Abs | '^' Abs | Abs1
Abs1: <INDEX> | <ABS> | Abs1 <INDEX> | Abs1 <PARAMS> | <PARAMS>
Decl: '*' Qual* Decl | '^' Decl | i | Decl <INDEX> | Decl <PARAMS> | <ARGS> <PARAMS> | <ARGS> <INDEX> | <DECL> <PARAMS> | <DECL> <INDEX> | <DECL>
Params: | Param | Param ',' Params1
Params1: v | Param | Param ',' Params1
Param: Type | Type Decl Attr* | Type Abs
Names: i | i ',' Names
Inits: Decl1 | Decl1 ',' Inits
Decl1: Decl Asm* | Decl Asm* '=' E | Decl Asm* '=' <INIT> | Decl ':' E
Asm: i <ARGS> | Attr
Fields: | Field Fields
Field: Type Inits? ';' | ';' | i <ARGS> ';'
Init: | Init1 | Init1 ',' | Init1 ',' Init
Init1: E | <INIT> | Desig+ '=' E | Desig+ '=' <INIT> | i ':' E | <RANGE> '=' E
Desig: '.' i | <INDEX>
Enum: | Enum1 | Enum1 ',' Enum
Enum1: i Attr* | i Attr* '=' E
For: Simple? ';' Comma? ';' Comma?
Comma: E | E ',' Comma
Simple: Comma | Type Inits
Stmts: | Stmt Stmts
Stmt: Simple? ';' | Attr+ ';' | typedef Type Inits ';' | Type ';' | <BLOCK> | if <ARGS> Stmt | if <ARGS> Stmt else Stmt | while <ARGS> Stmt | do Stmt while <ARGS> ';' | for <FOR> Stmt | switch <ARGS> Stmt | case E ':' Stmt? | case E v E ':' Stmt? | default ':' Stmt? | i ':' Stmt? | return Comma? ';' | break ';' | continue ';' | goto i ';' | goto '*' E ';' | i Qual* <ARGS> ';' | Type Decl <BLOCK>
Unit: | Top Unit
Top: Type Inits ';' | Type ';' | typedef Type Inits ';' | Type typedef Inits ';' | Type Decl Asm* <BLOCK> | Decl <BLOCK> | Type? OldDecl Old* <BLOCK> | extern s <TOP> | extern s Top | ';' | i <ARGS> ';'
OldDecl: '*' OldDecl | i <NAMES>
Old: Type Inits ';'
""",
}
LANGUAGES["c"]["("] |= {"DECL": "ParenDecl", "ABS": "ParenAbs"}
LANGUAGES["c"]["["] |= {"ATTR": "AttrIn", "RANGE": "Range"}
LANGUAGES["c"]["grammar"] = LANGUAGES["c"]["grammar"].replace("Attr: '[' | <ATTR>", "Attr: <ATTR>\nAttrIn: <ATTRIN>\nRange: E v E\nParenDecl: Qual* '*' Qual* Decl | '^' Qual* Decl | i <PARAMS> | Decl\nParenAbs: '*' Qual* Abs | '^' Qual* Abs")

_JAVA_TYPES = "void int long double float boolean char byte short"
LANGUAGES["java"] = {
    "keywords": f"if else for while do switch case default return break continue throw throws try catch finally class interface enum extends implements import package new instanceof static final public private protected abstract synchronized native transient volatile strictfp assert super this null {_JAVA_TYPES}".split(),
    "contextual": "record sealed permits non yield when module requires exports opens uses provides to with transitive open".split(),
    "operators": C_OPERATORS,
    "names": NAME,
    "blanks": r"\s",
    "lexer": rf'{BLOCK_COMMENT}|{LINE_COMMENT}|"""(?:[^\\]|\\[\s\S])*?"""|{DQ}|{SQ}|{NAME}|{NUMBER}',
    "(": {"ARGS": "Args", "PARAMS": "Params", "FOR": "For", "TYPE": "Type", "RES": "Resources", "CATCH": "CatchArg", "RECPAT": "RecPats", "ANN": "AnnArgs", "NAMES": "Names", "RECORD": "Params"},
    "[": {"INDEX": "E", "DIMS": "Nothing"},
    "{": {"BLOCK": "Stmts", "MEMBERS": "Members", "INIT": "Init", "ENUM": "Enum", "SWITCH": "Switch", "ANNS": "AnnInit", "MODULE": "Directives"},
    "starts": ("Unit", "Modular"),
    "islands": ("Stmt", "Member", "Top"),
    "stops": ";" + BRACES,
    "declares": r"\b(?:class|enum|record)\s+(\w+)",
    "grammar": """
Nothing:
E: Cond | L AsgOp E | Lambda
Cond: Bx | Bx '?' E ':' Cond | Bx '?' E ':' Lambda
Bx: U | Bx Bin U | Bx instanceof final? Type i? | Bx instanceof final? Pattern
Bin: '+-*/%&|^<>' | b | '>' '>' | '>' '=' | '>' '>' '>'
AsgOp: '=' | a | '>' '>' '=' | '>' '>' '>' '='
L: i | P '.' i | P <INDEX> | <ARGS>
U: P | Pre U | <TYPE> U | <TYPE> Lambda | switch <ARGS> <SWITCH>
Pre: '+-!~' | p
Lambda: i r Body | <NAMES> r Body | <PARAMS> r Body
Names: | i | i ',' Names
Body: E | <BLOCK>
P: i | n | s | this | super | null | <ARGS> | P <ARGS> | P <INDEX> | P '.' i | P '.' class | P '.' this | P '.' super | P '.' Gen i | P '.' Gen super | P '.' new New | P p | Ref c Gen? i | Ref c new | Prim Dims* '.' class | i Dims+ '.' class | P '.' i Dims+ '.' class | new New | Gen this | Gen super
Ref: P | Type
Dims: Ann* <DIMS>
New: Ann* Name <ARGS> <MEMBERS>? | Ann* NewType NewDim+ Dims* | Ann* NewType Dims+ <INIT> | Gen Name <ARGS> <MEMBERS>?
NewType: Name | Prim
NewDim: Ann* <INDEX>
Prim: int | long | double | float | boolean | char | byte | short | void
Name: Ann* i Gen? | Name '.' Ann* i Gen?
Gen: '<' TypeArgs? '>'
TypeArgs: TypeArg | TypeArg ',' TypeArgs
TypeArg: Type | Ann* '?' | Ann* '?' extends Type | Ann* '?' super Type
Ann: '@' Path <ANN>?
AnnArgs: | AnnVal | AnnPairs
AnnPairs: AnnPair | AnnPair ',' AnnPairs
AnnPair: i '=' AnnVal
AnnVal: Cond | Ann | <ANNS>
AnnInit: | ',' | AnnVal | AnnVal ',' | AnnVal ',' AnnInit
Type: Ann* Prim Dims* | Name Dims* | Type '&' Type
Args: | Args1
Args1: E | E ',' Args1
Params: | Param | Param ',' Params
Param: Mod* Type Ann* v? i Dims* | Mod* Type this | Mod* Type i '.' this
CatchArg: Mod* Types1 i
Types1: Type | Type '|' Types1
Resources: Res | Res ';' | Res ';' Resources
Res: Mod* Type i '=' E | P
Mod: Ann | public | private | protected | static | final | abstract | synchronized | native | transient | volatile | strictfp | default | sealed | non '-' sealed
TypeParams: '<' TypeParam '>'
TypeParam: Ann* i | Ann* i extends Type | TypeParam ',' TypeParam
Class: Mod* class i TypeParams? ExtOne? Implements? Permits? <MEMBERS> | Mod* interface i TypeParams? Extends? Permits? <MEMBERS> | Mod* enum i Implements? <ENUM> | Mod* '@' interface i <MEMBERS> | Mod* record i TypeParams? <RECORD> Implements? <MEMBERS>
ExtOne: extends Type
Extends: extends Types
Implements: implements Types
Permits: permits Types
Types: Type | Type ',' Types
Throws: throws Types
Enum: Consts? | Consts? ';' Members
Consts: Const | Const ',' | Const ',' Consts
Const: Ann* i <ARGS>? <MEMBERS>?
Members: | Member Members
Member: ';' | Class | Mod* Type Inits ';' | Mod* TypeParams? Ann* Type i <PARAMS> Dims* Throws? <BLOCK> | Mod* TypeParams? Ann* Type i <PARAMS> Dims* Throws? ';' | Mod* Type i <PARAMS> Dims* default AnnVal ';' | Mod* TypeParams? ctor <PARAMS> Throws? <BLOCK> | Mod* ctor <BLOCK> | static? <BLOCK>
Path: i | Path '.' i
Unit: | Top Unit
Top: Ann* package Path ';' | import static? Path ';' | import static? Path '.' '*' ';' | import i Path ';' | Class | ';' | Mod* TypeParams? Type i <PARAMS> Throws? <BLOCK>
Modular: Imports Ann* open? module Path <MODULE>
Imports: | import static? Path ';' Imports | import static? Path '.' '*' ';' Imports
Directives: | Directive Directives
Directive: requires transitive? static? transitive? Path ';' | exports Path To? ';' | opens Path To? ';' | uses Path ';' | provides Path with Paths ';'
To: to Paths
Paths: Path | Path ',' Paths
Inits: Init1 | Init1 ',' Inits
Init1: i Dims* | i Dims* '=' E | i Dims* '=' <INIT>
Init: | ',' | Elem | Elem ',' | Elem ',' Init
Elem: E | <INIT>
For: ForInit? ';' E? ';' Effects? | Mod* Type i Dims* ':' E
ForInit: Effects | Mod* Type Inits
Effects: Effect | Effect ',' Effects
Effect: L AsgOp E | P p | p U | P <ARGS> | new New | P '.' new New
Stmts: | Stmt Stmts
Stmt: ';' | Effect ';' | Mod* Type Inits ';' | <BLOCK> | if <ARGS> Stmt | if <ARGS> Stmt else Stmt | while <ARGS> Stmt | do Stmt while <ARGS> ';' | for <FOR> Stmt | switch <ARGS> <SWITCH> | i ':' Stmt | return E? ';' | break i? ';' | continue i? ';' | throw E ';' | yield E ';' | Try | Class | assert E ';' | assert E ':' E ';' | synchronized <ARGS> <BLOCK>
Try: try <BLOCK> Catch+ | try <BLOCK> Catch* finally <BLOCK> | try <RES> <BLOCK> Catch* Finally?
Finally: finally <BLOCK>
Catch: catch <CATCH> <BLOCK>
Switch: | SLabel ':' Stmts Switch | SLabel r Arm Switch
SLabel: case CaseItems Guard? | default
CaseItems: CaseItem | CaseItem ',' CaseItems
CaseItem: Cond | Mod* Pattern | default
Pattern: Type i | Type <RECPAT> i?
RecPats: | RecPat | RecPat ',' RecPats
RecPat: Mod* Pattern | i
Guard: when E
Arm: E ';' | <BLOCK> | throw E ';'
""",
}

_CS_TYPES = "void int long double float bool char byte sbyte short ushort string object uint ulong decimal"
LANGUAGES["csharp"] = {
    "keywords": f"if else for foreach while do switch case default return break continue throw try catch finally class interface enum struct namespace using new is as in out ref static readonly const public private protected internal abstract sealed virtual override extern unsafe lock base this typeof sizeof checked unchecked fixed stackalloc event delegate operator implicit explicit params goto null true false volatile {_CS_TYPES}".split(),
    "contextual": "record async await var yield get set init add remove value where when partial required file global scoped managed unmanaged with and or not from select let join on equals orderby ascending descending group by into nameof alias notnull dynamic field".split(),
    "operators": C_OPERATORS | {"??": "b", "??=": "a", "?.": "q", "..": "v"},
    "names": NAME,
    "lexer": rf'{BLOCK_COMMENT}|{LINE_COMMENT}|^[ \t]*#[ \t]*(?:region|endregion|if|else|elif|endif|pragma|nullable|define|undef|warning|error|line)\b[^\n]*|\$*"""+[\s\S]*?"""+|(?:\$@|@\$)"(?:[^"{{]|""|{{{{|{{[^"{{}}]*(?:"[^"]*"[^"{{}}]*)*}})*"|@"(?:[^"]|"")*"|\$"(?:[^"\\\n{{]|\\.|{{{{|{{[^"{{}}\n]*(?:"(?:[^"\\\n]|\\.)*"[^"{{}}\n]*)*}})*"|{DQ}(?:u8)?|{SQ}|@?{NAME}|{NUMBER}',
    "(": {"ARGS": "Args", "PARAMS": "Params", "FOR": "For", "EACH": "Each", "TYPE": "Type", "TTUPLE": "TypeTuple", "DECL": "Decl", "CATCH": "CatchArg", "POSPAT": "PosPats", "NAMES": "Names", "DECON": "Decons"},
    "[": {"INDEX": "Args1", "RANK": "Commas", "ATTR": "Attrs", "LISTPAT": "ListPats", "COLL": "Coll", "PARAMSX": "Params"},
    "{": {"BLOCK": "Stmts", "MEMBERS": "Members", "INIT": "Init", "ENUM": "Enum", "SWITCH": "Switch", "ARMS": "Arms", "SPACE": "Unit", "ACCESS": "Accesses", "PROPPAT": "PropPats"},
    "starts": ("Unit",),
    "islands": ("Stmt", "Member", "Top"),
    "stops": ";" + BRACES,
    "declares": r"\b(?:class|struct|record(?:\s+(?:struct|class))?)\s+(\w+)",
    "grammar": """
E: Cond | U AsgOp E | Lambda | Query | throw E
Cond: Bx | Bx '?' E ':' E
Bx: U | Bx Bin U | Bx is Pat | Bx as Type
Bin: '+-*/%&|^<>' | b | v | '>' '>' | '>' '=' | '>' '>' '>'
AsgOp: '=' | a | '>' '>' '=' | '>' '>' '>' '='
U: P | Pre U | <TYPE> U | await U | ref U | v U? | P v
Pre: '+-*&!~^' | p
Lambda: Attr* LMod* i k Body | Attr* LMod* <NAMES> k Body | Attr* LMod* Type? <PARAMS> k Body | LMod* delegate <PARAMS>? <BLOCK>
LMod: async | static
Names: | i | i ',' Names
Body: E | <BLOCK>
P: i | i Gen | n | s | this | base | null | true | false | Prim | <ARGS> | P <ARGS> | P <INDEX> | P '.' i Gen? | P q i Gen? | P '?' <INDEX> | P r i | P p | P '!' | i c i | typeof <TYPE> | typeof <ARGS> | sizeof <TYPE> | default <TYPE> | default | checked <ARGS> | unchecked <ARGS> | new New | stackalloc Type? <INDEX> <INIT>? | <COLL> | P switch <ARMS> | P with <INIT>
New: Type <ARGS> <INIT>? | Type <INIT> | <RANK> <INIT> | <ARGS> <INIT>? | <INIT> | NType <INDEX> <RANK>* <INIT>? | NType <RANK>+ <INIT>
NType: Prim | Name | NType '?' | <TTUPLE>
Query: from Type? i in E Clauses
Clauses: Clause* Last Into?
Into: into i Clauses
Clause: from Type? i in E | let i '=' E | where E | join Type? i in E on E equals E | join Type? i in E on E equals E into i | orderby Keys
Keys: Key | Key ',' Keys
Key: E | E ascending | E descending
Last: select E | group E by E
Pat: Pat1 | Pat and Pat | Pat or Pat
Pat1: not Pat1 | Cond1 | Type i? | RelOp Bx | Type? <PROPPAT> i? | Type? <POSPAT> <PROPPAT>? i? | <LISTPAT> i? | v Pat1? | <PARENPAT> | var <NAMES>
Cond1: U | Cond1 '+-*/%&|^' U
RelOp: '<>' | b | '>' '='
PosPats: | PosPat | PosPat ',' PosPats
PosPat: Pat | i ':' Pat
ParenPat: Pat
PropPats: | PropPat | PropPat ',' | PropPat ',' PropPats
PropPat: Path ':' Pat | Pat
ListPats: | Pat | Pat ',' | Pat ',' ListPats
Coll: | Elem | Elem ',' | Elem ',' Coll
Elem: E | v E
Prim: int | long | double | float | bool | char | byte | sbyte | short | ushort | string | object | uint | ulong | decimal | void
Name: i Gen? | Name '.' i Gen? | Name c i Gen?
Gen: '<' TypeArgs? '>'
TypeArgs: TypeArg | ',' TypeArgs | TypeArg ',' | TypeArg ',' TypeArgs
TypeArg: Attr* Type | Attr* in Type | Attr* out Type
Type: Prim Suffix* | Name Suffix* | <TTUPLE> Suffix* | ref readonly? Type | delegate '*' Gen | scoped Type
Suffix: <RANK> | '?' | '*'
TypeTuple: Type i? ',' TypeTuple1
TypeTuple1: Type i? | Type i? ',' TypeTuple1
Commas: | ',' Commas
Args: | Args1
Args1: Arg | Arg ',' Args1
Arg: ArgV | i ':' ArgV
ArgV: E | out Type i | out E | ref E | in E | Type i
Params: | Param | Param ',' Params
Param: Attr* PMod* Type i | Attr* PMod* Type i '=' E | i
PMod: ref | out | in | this | params | scoped | readonly
Attr: <ATTR>
Attrs: AttrTo? Attrs1 | AttrTo? Attrs1 ','
AttrTo: i ':' | return ':' | event ':'
Attrs1: Attr1 | Attr1 ',' Attrs1
Attr1: Name <ATTRARGS>?
AttrArgs: | AttrArg | AttrArg ',' AttrArgs
AttrArg: E | i ':' E
Mod: public | private | protected | internal | static | readonly | const | abstract | sealed | virtual | override | async | extern | unsafe | partial | new | required | file | ref | volatile | fixed
Where: where i ':' Bounds
Bounds: Bound | Bound ',' Bounds
Bound: Type | class '?'? | struct | new <ARGS> | default
Bases: ':' Bases1
Bases1: Type <ARGS>? | Type <ARGS>? ',' Bases1
Class: Attr* Mod* Kind i Gen? <PARAMS>? Bases? Where* <MEMBERS> ';'? | Attr* Mod* Kind i Gen? <PARAMS>? Bases? Where* ';' | Attr* Mod* enum i Bases? <ENUM> ';'? | Attr* Mod* delegate Type i Gen? <PARAMS> Where* ';'
Kind: class | interface | struct | record | record struct | record class
Enum: | Enum1 | Enum1 ',' Enum
Enum1: Attr* i | Attr* i '=' E
Accesses: Access Accesses1
Accesses1: | Access Accesses1
Access: Attr* Mod* Acc ';' | Attr* Mod* Acc <BLOCK> | Attr* Mod* Acc k E ';'
Acc: get | set | init | add | remove
Members: | Member Members
Member: ';' | Class | Attr* Mod* event? Type Inits ';' | Attr* Mod* event Type Name <ACCESS> | Attr* Mod* Type Name <PARAMS> Where* MBody | Attr* Mod* ctor <PARAMS> Ctor? MBody | '~' i <PARAMS> MBody | Attr* '~' i <PARAMS> MBody | Attr* Mod* Type Name PBody | Attr* Mod* Type This <PARAMSX> PBody | Attr* Mod* Type operator checked? OpName <PARAMS> MBody | Attr* Mod* implicit operator Type <PARAMS> MBody | Attr* Mod* explicit operator checked? Type <PARAMS> MBody
This: this | Name '.' this
MBody: <BLOCK> ';'? | ';' | k E ';'
PBody: <ACCESS> | <ACCESS> '=' E ';' | k E ';'
OpName: '+-*/%&|^<>!~' | b | p | '>' '=' | '>' '>' | true | false
Ctor: ':' base <ARGS> | ':' this <ARGS>
Path: i | Path '.' i | Path c i
Unit: | Top Unit
Top: global? using static? unsafe? Path ';' | global? using static? Name ';' | global? using i '=' Type ';' | extern i i ';' | namespace Path <SPACE> ';'? | namespace Path ';' | Class | <ATTR> | Stmt
Decl: Type Inits | await? Type Inits
Decons: Decon ',' Decons1
Decons1: Decon | Decon ',' Decons1
Decon: Type i | i | <DECON> | var i
Each: Type i in E | var <DECON> in E | <DECON> in E | var <NAMES> in E | <NAMES> in E
CatchArg: Type i?
Inits: Init1 | Init1 ',' Inits
Init1: i | i '=' E | i '=' <INIT> | i <INDEX>
Init: | ',' | Item | Item ',' | Item ',' Init
Item: E | <INIT> | <INDEX> '=' E | i '=' <INIT> | <INDEX> '=' <INIT>
For: ForInit? ';' E? ';' Es?
ForInit: Es | Type Inits
Es: E | E ',' Es
Stmts: | Stmt Stmts
Stmt: ';' | E ';' | Mod* Type Inits ';' | var <DECON> '=' E ';' | var <NAMES> '=' E ';' | <DECON> '=' E ';' | <BLOCK> | if <ARGS> Stmt | if <ARGS> Stmt else Stmt | while <ARGS> Stmt | do Stmt while <ARGS> ';' | for <FOR> Stmt | await? foreach <EACH> Stmt | switch <ARGS> <SWITCH> | i ':' Stmt | return E? ';' | break ';' | continue ';' | throw E? ';' | goto i ';' | goto case E ';' | goto default ';' | Try | lock <ARGS> Stmt | await? using <DECL> Stmt | await? using <ARGS> Stmt | await? using Type Inits ';' | yield return E ';' | yield break ';' | Attr* Mod* Type i Gen? <PARAMS> Where* MBody | unsafe <BLOCK> | checked <BLOCK> | unchecked <BLOCK> | fixed <DECL> Stmt
Try: try <BLOCK> Catch+ | try <BLOCK> Catch* finally <BLOCK>
Catch: catch <CATCH>? When? <BLOCK>
When: when <ARGS>
Switch: | SLabel+ Stmts Switch
SLabel: case Pat CWhen? ':' | default ':'
CWhen: when E
Arms: | Arm | Arm ',' | Arm ',' Arms
Arm: Pat CWhen? k E
""",
}
LANGUAGES["csharp"]["("] |= {"PARENPAT": "ParenPat", "ATTRARGS": "AttrArgs"}

_JS_RESERVED = "if else for while do switch case default return break continue throw try catch finally class extends function var let const new typeof void delete in instanceof import export this super with null true false debugger enum".split()
_JS_CONTEXTUAL = "of from async await yield static get set as type interface accessor".split()
_JS = """
Semi: ';' | nl | eof
Seq: E | E ',' Seq
E: Cond | L AsgOp E | Arrow | yield E? | yield '*' E | async Arrow
Cond: Bx | Bx '?' E ':' E
Bx: U | Bx Bin U | Bx in U | Bx instanceof U
Bin: '+-*/%&|^<>' | b | '>' '>' | '>' '=' | '>' '>' '>'
AsgOp: '=' | a | '>' '>' '=' | '>' '>' '>' '='
L: i | P '.' Any | P '.' '#' Any | P <INDEX> | P <KEY> | <ARGS> | <OBJECT> | <INDEX>
U: P | Pre U
Pre: '+-!~' | p | typeof | void | delete | await
Fn: async? function '*'? i? Gen? <PARAMS> Ret? <BLOCK>
ClassE: Deco* class i? Gen? Extends? <CLASS>
Arrow: i k Body | Gen? <PARAMS> Ret? k Body
Body: ^{ E | <BLOCK>
P: i | n | s | this | super | null | true | false | import <ARGS> | import '.' i | <ARGS> | <INDEX> | <OBJECT> | P <ARGS> | P Gen <ARGS> | P <KEY> | P s | P '.' Any | P '.' '#' Any | P q Any | P q '#' Any | P q <ARGS> | P q <KEY> | P p | P '!' | new P | new '.' i | '#' i | Fn | ClassE | P Gen s
Args: | Arg | Arg ',' | Arg ',' Args
Arg: E | v E
Elems: | Arg | ',' Elems | Arg ',' Elems
Params: | Param | Param ',' | Param ',' Params
Param: Acc* Target Opt? Ann | Acc* Target Opt? Ann '=' E | v Target Ann
Target: i | <OBJECT> | <INDEX> | This
Object: | Prop | Prop ',' | Prop ',' Object
Prop: v E | Key ':' E | i | i '=' E | Method
Key: Any | n | s | <KEY> | '#' Any
Method: MMod* '*'? Key Opt? Gen? <PARAMS> Ret? <BLOCK>
MMod: static | async | get | set | Acc
Members: | Member Members
Member: ';' | Deco* Method | Deco* FMod* Key Opt? Ann Semi | Deco* FMod* Key Opt? Ann '=' E Semi | static <BLOCK>
FMod: static | accessor | Acc
Deco: '@' DecoE
DecoE: i | DecoE '.' Any | DecoE Gen? <ARGS> | <ARGS>
Extends: extends Heir Gen? Impl? | Impl
Heir: P
For: ForInit? ';' Seq? ';' Seq? | VarFor of E | VarFor in Seq | L of E | L in Seq
VarFor: VarKind Target Ann
VarKind: var | let | const
ForInit: Seq | VarKind Inits
Inits: Init1 | Init1 ',' Inits
Init1: i Opt1? Ann | i Opt1? Ann '=' E | Pat Ann '=' E
ConstInits: ConstInit | ConstInit ',' ConstInits
ConstInit: i Opt1? Ann '=' E | Pat Ann '=' E
Pat: <OBJECT> | <INDEX>
Var: var Inits Semi | let Inits Semi | const ConstInits Semi
Names: | NameAs | NameAs ',' | NameAs ',' Names
NameAs: TypeOnly? Name1 | TypeOnly? Name1 as Name1
Name1: Any | s
Clause: i | <NAMES> | '*' as i | i ',' <NAMES> | i ',' '*' as i
From: from s With? Semi
With: with <OBJECT> | i <OBJECT>
Stmts: | Stmt Stmts
Stmt: ';' | ^function ^class ^{ Seq Semi | Var | <BLOCK> | if <ARGS> Stmt | if <ARGS> Stmt else Stmt | while <ARGS> Stmt | do Stmt while <ARGS> Semi? | for await? <FOR> Stmt | switch <ARGS> <SWITCH> | i ':' Stmt | return Seq? Semi | break i? Semi | continue i? Semi | throw Seq Semi | try <BLOCK> Catch Finally? | try <BLOCK> Finally | FnDecl | ClassDecl | with <ARGS> Stmt | debugger Semi
FnDecl: async? function '*'? i Gen? <PARAMS> Ret? <BLOCK>
ClassDecl: Deco* class i Gen? Extends? <CLASS>
Catch: catch <BLOCK> | catch <PARAMS> <BLOCK>
Finally: finally <BLOCK>
Cases: | case Seq ':' Stmts Cases | default ':' Stmts Cases
Script: | Stmt Script
Module: | Mod Module
Mod: Stmt | import s With? Semi | import TypeOnly? Clause From | export default E Semi | export default FnAnon | export default ClassAnon | export Decl | export <NAMES> Semi | export TypeOnly? <NAMES> From | export TypeOnly? '*' From | export TypeOnly? '*' as Name1 From | Deco* export default? Deco* class i? Gen? Extends? <CLASS>
FnAnon: Fn
ClassAnon: ClassE
Decl: Var | FnDecl | ClassDecl
"""
_NEVER = "\n".join(f"{x}: ':' ':' ':'" for x in ("Ret", "Opt", "Opt1", "Gen", "Acc", "Impl", "TypeOnly", "This"))
_TS_ONLY = """
This: this
TypeOnly: type
Ann: | ':' T
Ret: ':' T | ':' i is T | ':' asserts i | ':' asserts i is T | ':' this is T | ':' asserts this | ':' asserts this is T
Opt: '?' | '!'
Opt1: '!'
Gen: '<' GenArgs '>'
GenArgs: GenArg | GenArg ',' | GenArg ',' GenArgs
GenArg: GMod* T | GMod* i extends T | GMod* i '=' T | GMod* i extends T '=' T
GMod: const | in | out
Acc: public | private | protected | readonly | abstract | override | declare | Deco
Impl: implements Ts
Ts: T | T ',' Ts
T: T1 | T '|' T1 | T '&' T1 | '|' T1 | '&' T1 | T extends T '?' T ':' T | Gen? <PARAMS> k TRet | abstract? new Gen? <PARAMS> k T
TRet: T | i is T | asserts i | asserts i is T | this is T | asserts this is T
T1: i | void | null | true | false | n | s | '-' n | import <ARGS> | T1 '.' Any | T1 Gen | T1 <TINDEX> | <TTUPLE> | <MEMBERS> | <MAPPED> | <TPAREN> | typeof TypeQuery | Prefix T1 | this | infer i extends T1 | T1 '!' | T1 '?'
TypeQuery: i | import <ARGS> | this | TypeQuery '.' Any | TypeQuery '.' '#' i | TypeQuery Gen
Prefix: readonly | keyof | unique | infer
TIndex: | T
TTuple: | TElem | TElem ',' | TElem ',' TTuple
TElem: T | v T | Any '?'? ':' T | v Any ':' T | T '?'
TMembers: | TMember | Sep TMembers | TMember Sep TMembers
Sep: ',' | ';' | nl
TMember: TMod* Key Opt? Ann | TMod* Key Opt? Gen? <PARAMS> Ret? | Gen? <PARAMS> Ret? | new Gen? <PARAMS> Ret? | TMod* <INDEXSIG> ':' T
TMod: readonly | static | get | set
Mapped: Ro? <MAPSIG> MOpt? ':' T End | Ro? <MAPSIG> MOpt? End
Ro: readonly | '+-' readonly
MOpt: '?' | '+-' '?'
End: | ';' | ',' | nl
MapSig: i in T | i in T as T
IndexSig: i ':' T
Cond: Cond as T | Cond as const | Cond satisfies T
Bx: Bx as T | Bx as const | Bx satisfies T
U: '<' T '>' U | '<' const '>' U
L: P '!' | '<' T '>' U
P: P Gen
Heir: P Gen
Member: Deco* MMod* '*'? Key Opt? Gen? <PARAMS> Ret? Semi | Deco* FMod* <INDEXSIG> ':' T Semi
Decl: TDecl
Stmt: TDecl
TDecl: type i Gen? '=' T Semi | interface i Gen? IExt? <MEMBERS> | declare TDecl | declare DVar | declare async? function '*'? i Gen? <PARAMS> Ret? Semi | declare ClassDecl | abstract ClassDecl | declare abstract ClassDecl | const? enum i <ENUM> | namespace Path <SPACE> | module Path <SPACE> | module s <SPACE> | module s Semi | declare global <SPACE> | async? function '*'? i Gen? <PARAMS> Ret? Semi | import TypeOnly? i '=' E Semi
DVar: VarKind DInits Semi
DInits: DInit | DInit ',' DInits
DInit: i Ann | i Ann '=' E | Pat Ann
Path: i | Path '.' i
IExt: extends Ts
Enum: | Enum1 | Enum1 ',' Enum
Enum1: Any | s | <KEY> | Any '=' E | s '=' E
Mod: export '=' E Semi | export i i i Semi | export default i i Gen? IExt? <MEMBERS> | export default abstract ClassAnon | export default FnSig
FnSig: async? function '*'? i? Gen? <PARAMS> Ret? Semi
"""
_REGEX = r"(?=/)(?:(?<=[=(,:;!&|?{}\[\n+>])|(?<=[=(,:;!&|?{}\[+>] )|(?<=return )|(?<=typeof )|(?<=case )|(?<=^))/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{[^{}`]*\})*\})*`"
_JS_NAME = r"[^\W\d]\w*(?:\$\w*)*"
_JS_LEXER = rf"{BLOCK_COMMENT}|{LINE_COMMENT}|\A#![^\n]*|{_REGEX}|{DQ}|{SQ}|{_TEMPLATE}|{_JS_NAME}|\$[\w$]*|{NUMBER}|\n"
_ANY = "\nAny: i | " + " | ".join(_JS_RESERVED) + "\n"
LANGUAGES["javascript"] = {
    "keywords": _JS_RESERVED,
    "contextual": _JS_CONTEXTUAL,
    "operators": JS_OPERATORS,
    "names": _JS_NAME,
    "blanks": r"[^\S\n]",
    "lexer": _JS_LEXER,
    "newlines": True,
    "(": {"ARGS": "ArgsS", "PARAMS": "Params", "FOR": "For"},
    "[": {"INDEX": "Elems", "KEY": "Seq"},
    "{": {"BLOCK": "Stmts", "CLASS": "Members", "OBJECT": "Object", "NAMES": "Names", "SWITCH": "Cases"},
    "starts": ("Module", "Script"),
    "islands": ("Stmt", "Member", "Mod"),
    "stops": ";\n" + BRACES,
    "skip": True,
    "grammar": _JS + _NEVER + _ANY + "Ann:\nArgsS: Args | Seq\n",
}
LANGUAGES["typescript"] = {
    "keywords": _JS_RESERVED,
    "contextual": [*_JS_CONTEXTUAL, *"public private protected readonly abstract override declare implements keyof unique infer is satisfies asserts namespace module global out".split()],
    "operators": JS_OPERATORS,
    "names": _JS_NAME,
    "blanks": r"[^\S\n]",
    "lexer": _JS_LEXER,
    "newlines": True,
    "(": {"ARGS": "ArgsS", "PARAMS": "Params", "FOR": "For", "TPAREN": "T"},
    "[": {"INDEX": "Elems", "KEY": "Seq", "TINDEX": "TIndex", "TTUPLE": "TTuple", "INDEXSIG": "IndexSig", "MAPSIG": "MapSig"},
    "{": {"BLOCK": "Stmts", "CLASS": "Members", "OBJECT": "Object", "NAMES": "Names", "SWITCH": "Cases", "MEMBERS": "TMembers", "MAPPED": "Mapped", "ENUM": "Enum", "SPACE": "Module"},
    "starts": ("Module", "Script"),
    "islands": ("Stmt", "Member", "Mod"),
    "stops": ";\n" + BRACES,
    "skip": True,
    "grammar": _JS + _TS_ONLY + _ANY + "ArgsS: Args | Seq\n",
}

LANGUAGES["rust"] = {
    "keywords": "if else for while loop match return break continue fn pub struct enum trait impl use mod const static let mut ref as in where type unsafe async await dyn move extern crate self".split(),
    "contextual": "union auto default".split(),
    "operators": RUST_OPERATORS,
    "names": rf"(?![bcr][r#\"'])(?:{NAME})",
    "blanks": r"\s",
    "lexer": rf"{BLOCK_COMMENT}|{LINE_COMMENT}|[bc]?r\"[^\"]*\"|[bc]?r#\"[\s\S]*?\"#|[bc]?r##\"[\s\S]*?\"##|[bc]?r###\"[\s\S]*?\"###|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\[^\n]+?)'|'{NAME}(?!')|(?:r#)?{NAME}|(?:0[xbo][0-9a-fA-F_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?\d+)?)[a-z0-9_]*",
    "nested_comments": True,
    "(": {"ARGS": "Args", "PARAMS": "Params", "TREE": "Tree", "TYPES": "Types", "PATS": "Pats", "FIELDS": "TFields"},
    "[": {"INDEX": "Index", "TREE": "Tree", "TYPES": "TArray", "PATS": "Pats"},
    "{": {"BLOCK": "Block", "ITEMS": "Items", "FIELDS": "Fields", "ENUM": "Enum", "ARMS": "Arms", "LIT": "Lit", "USES": "Uses", "TREE": "Tree", "PATS": "PFields"},
    "starts": ("Unit",),
    "islands": ("Stmt", "Item", "Arm", "Last"),
    "stops": ";" + BRACES,
    "grammar": """
E: U | E Bin U | E as T | E v U? | v U? | Closure | return E? | break E? | break l E? | continue l? | E Bin Tail | let Pat '=' E | Attr E
Tail: Closure | return E? | break l? E? | continue l? | v U?
Bin: '+-*/%&|^<>=' | b | a | o | '>' '>' | '>' '=' | '>' '>' '='
U: P | Pre U | Pre Closure
Pre: '-*&!' | '&' mut | b b | b mut | b | '&' i const | '&' i mut
P: Path | n | s | self | Block1 | <ARGS> | <INDEX> | P <ARGS> | P <INDEX> | P '.' i | P '.' n | P '.' await | P '.' i c '<' Ts '>' | P '?' | Path '!' Tok | Path <LIT>
Tok: <TREE>
Block1: <BLOCK> | unsafe <BLOCK> | async move? <BLOCK> | If | match E <ARMS> | Label? loop <BLOCK> | Label? while E <BLOCK> | Label? for Pat in E <BLOCK> | const <BLOCK> | Label <BLOCK>
Label: l ':'
If: if E <BLOCK> | if E <BLOCK> else If | if E <BLOCK> else <BLOCK>
Closure: static? async? move? Pipes E | static? async? move? Pipes Ret <BLOCK>
Pipes: '|' PatTs '|' | o
PatTs: | PatT | PatT ',' PatTs
PatT: Attr* Pat1 | Attr* Pat1 ':' T
Path: Seg | c Seg | Path c Seg | '<' T '>' c Seg | '<' T as T '>' c Seg
Seg: i | self | crate | '<' Ts '>' | i '<' Ts '>'
Args: | Attr* E | Attr* E ',' | Attr* E ',' Args
Index: | E | E ',' Index | E ';' E
Lit: | v E? | LitF | LitF ',' Lit
LitF: Attr* i | Attr* i ':' E | Attr* n ':' E
T: TPath | '&' l? mut? T | b l? mut? T | '*' const T | '*' mut T | <TYPES> | dyn Bounds1 | impl Bounds1 | T '+' T | T '+' l | '!' | fn <TYPES> Ret? | unsafe? extern s? fn <TYPES> Ret? | unsafe fn <TYPES> Ret? | for '<' Ls? '>' T | '?' T | T '!' <TREE> | Call
Ls: l | l ',' Ls | l ':' l | l ':' l ',' Ls
Call: i <TYPES> Ret? | TPath c i <TYPES> Ret?
TPath: Seg | TPath c Seg | c Seg | '<' T as T '>' c Seg | '<' T '>' c Seg
Ts: | TArg | TArg ',' Ts
TArg: T | l | n | <BLOCK> | i '=' T | i '<' Ts '>' '=' T | i ':' Bounds | '-' n | s | i '=' n
Types: | Attr* TParam1 | Attr* TParam1 ',' Types
TParam1: T | i ':' T | v
TArray: T | T ';' E
Pat: Pat1 | Pat '|' Pat1 | '|' Pat1
Pat1: Path | n | s | '-' n | <PATS> | Path <PATS> | '&' mut? Pat1 | b mut? Pat1 | ref? mut? i | ref? mut? i '@' Pat1 | v | Pat1 v Pat1? | v Pat1 | Path '!' <TREE> | mut? self | const <BLOCK>
Pats: | Attr* Pat | Attr* Pat ',' Pats
PFields: | Attr* v | PField | PField ',' PFields
PField: Attr* ref? mut? i | Attr* i ':' Pat | Attr* n ':' Pat
Arms: | Arm Arms
Arm: Attr* Pat Guard? k E ',' | Attr* Pat Guard? k Block1 | Attr* Pat Guard? k E eof
Guard: if E
Ret: r T
Params: | Attr* Param | Attr* Param ',' Params
Param: Self | Pat ':' T | Pat ':' v | v | T
Self: mut? self | mut? self ':' T | '&' l? mut? self
Attr: '#' <TREE> | '#' '!' <TREE>
Vis: pub | pub <TREE> | crate
TParams: '<' TParam? '>'
TParam: TP1 | TP1 ',' | TP1 ',' TParam
TP1: Attr* TP2
TP2: i | i ':' Bounds | i '=' T | i ':' Bounds '=' T | l | l ':' Bounds | const i ':' T | const i ':' T '=' TArg
Bounds: | Bound | Bound '+' Bounds
Bounds1: Bound | Bound '+' Bounds1
Bound: TBase | l | '?' TBase | for '<' Ls? '>' TBase | '~' const TBase | const TBase | <TYPES> | use '<' Ts '>'
TBase: TPath | Call
Where: where Preds
Preds: | Pred | Pred ',' Preds
Pred: T ':' Bounds | l ':' Bounds | for '<' Ls? '>' T ':' Bounds
FnHead: const? async? unsafe? FnExt? fn i TParams? <PARAMS> Ret? Where?
FnExt: extern | extern s
Fields: | Attr* Vis? i ':' T | Attr* Vis? i ':' T ',' Fields
TFields: | Attr* Vis? T | Attr* Vis? T ',' TFields
Enum: | Variant | Variant ',' Enum
Variant: Attr* Vis? i <FIELDS>? | Attr* Vis? i <FIELDS>? '=' E
Uses: | Use | Use ',' Uses
Use: c? UseP | c? UseP as i | '*' | <USES> | c <USES> | c '*' | c? UseP c '*' | c? UseP c <USES>
UseP: i | self | crate | UseP c i | UseP c self
Unit: | Item Unit
Items: | Item Items
Item: Attr* Vis? Item1 | '#' '!' <TREE> | Path '!' i? <TREE> ';'? | Attr+ Path '!' i? <TREE> ';'?
Item1: default? FnHead <BLOCK> | default? FnHead ';' | struct i TParams? Where? <FIELDS> | struct i TParams? <FIELDS> Where? ';' | struct i TParams? Where? ';' | union i TParams? Where? <FIELDS> | enum i TParams? Where? <ENUM> | unsafe? auto? trait i TParams? TBound? Where? <ITEMS> | trait i TParams? '=' Bounds Where? ';' | default? unsafe? impl TParams? '!'? T Where? <ITEMS> | default? unsafe? impl TParams? const? '!'? T for T Where? <ITEMS> | use Use ';' | unsafe? mod i ';' | unsafe? mod i <ITEMS> | default? const i TParams? ':' T '=' E ';' | const i ':' T ';' | static mut? i ':' T '=' E ';' | static mut? i ':' T ';' | default? type i TParams? TBound? Where? '=' T Where? ';' | type i TParams? TBound? Where? ';' | extern crate i ';' | extern crate self as i ';' | extern crate i as i ';' | unsafe? extern s? <ITEMS>
TBound: ':' Bounds
Block: | Stmt Block | Last
Last: Attr* E eof
Stmt: ';' | Item | Attr* let Pat LType? ';' | Attr* let Pat LType? '=' E ';' | Attr* let Pat LType? '=' E else <BLOCK> ';' | Attr* E ';' | Attr* Block1 | '#' '!' <TREE> | Attr* Block1 '.' i
LType: ':' T
Tree: Any*
Any: x | '+-*/%&|^<>=!?:;,.#@$~' | s | n | l | i | self | crate | b | a | p | r | k | c | v | o | <TREE> | Words
""",
}
LANGUAGES["rust"]["grammar"] += "Words: " + " | ".join(LANGUAGES["rust"]["keywords"]) + "\n"
LANGUAGES["rust"]["grammar"] = LANGUAGES["rust"]["grammar"].replace("Any: x | ", "Any: ").replace(" | Attr* Block1 '.' i\nLType", "\nLType")

LANGUAGES["go"] = {
    "keywords": "if else for switch select case default return break continue goto fallthrough defer go func package import type struct interface map chan var const range".split(),
    "contextual": [],
    "operators": GO_OPERATORS,
    "names": NAME,
    "blanks": r"[^\S\n]",
    "lexer": rf"{BLOCK_COMMENT}|{LINE_COMMENT}|`[^`]*`|{DQ}|'(?:[^'\\\n]|\\[^\n]+?)'|{NAME}|{NUMBER}|\n",
    "newlines": True,
    "(": {"ARGS": "Args", "PARAMS": "Params", "IMPORTS": "Imports", "VARS": "Vars", "CONSTS": "Consts", "TYPE": "T", "TYPES": "TypeSpecs", "SWITCHTYPE": "TypeWord"},
    "[": {"INDEX": "Index", "TYPE": "TArr", "TPARAMS": "TParams"},
    "{": {"BLOCK": "Block", "FIELDS": "Fields", "METHODS": "Methods", "LIT": "Lit", "CASES": "Cases", "COMMS": "Comms"},
    "starts": ("File",),
    "islands": ("Stmt", "Top"),
    "stops": ";" + BRACES,
    "grammar": """
E: U | E Bin U
Bin: '+-*/%&|^<>' | b
U: P | Pre U
Pre: '+-*&!^' | w
P: i | n | s | <ARGS> | P <ARGS> | P <INDEX> | P '.' i | P '.' <TYPE> | LitT <LIT> | i <LIT> | i '.' i <LIT> | i <INDEX> <LIT> | i '.' i <INDEX> <LIT> | func <PARAMS> Result? <BLOCK> | Conv <ARGS> | <TYPE>
LitT: Arr T | map <INDEX> T | struct <FIELDS>
Conv: Arr T | map <INDEX> T | chan T | interface <METHODS> | func <PARAMS> Result?
Arr: <INDEX> | <TYPE>
T: i | i '.' i | i <INDEX> | i '.' i <INDEX> | '*' T | Arr T | map <INDEX> T | chan T | chan w T | w chan T | func <PARAMS> Result? | struct <FIELDS> | interface <METHODS> | <TYPE>
TArr: | E | v | T
Result: T | <PARAMS>
Args: | Arg | Arg ',' | Arg ',' Args
Arg: E | E v | T
Index: | E | E? ':' E? | E? ':' E ':' E | T | T ',' Index | v
Params: | Param | Param ',' | Param ',' Params
Param: T | v T | i T | i v T
TParams: TParam | TParam ',' | TParam ',' TParams
TParam: i | i Union
Union: TTerm | Union '|' TTerm
TTerm: T | '~' T
Lit: | Elem | Elem ',' | Elem ',' Lit
Elem: V | V ':' V
V: E | <LIT>
Fields: | ';' Fields | Field | Field ';' Fields
Field: Ids T s? | '*'? T s?
Ids: i | i ',' Ids
Methods: | ';' Methods | Method | Method ';' Methods
Method: i <PARAMS> Result? | Union
Es: E | E ',' Es
Imports: | ';' Imports | Imp | Imp ';' Imports
Imp: s | i s | '.' s
Vars: | ';' Vars | VarS | VarS ';' Vars
VarS: Ids T | Ids T? '=' Es
Consts: | ';' Consts | ConstS | ConstS ';' Consts
ConstS: Ids T? '=' Es | Ids
TypeSpecs: | ';' TypeSpecs | TypeS | TypeS ';' TypeSpecs
TypeS: i T | i '=' T | i <TPARAMS> T | i <TPARAMS> '=' T
TypeWord: type
Simple: Es | Es '=' Es | Ids d Es | Es a Es | E p | E w E
Block: | Stmt Block
Stmt: ';' | Stmt1 ';' | Stmt1 eof | i ':' | i ':' eof
Stmt1: Simple | var VarS | var <VARS> | const ConstS | const <CONSTS> | type TypeS | type <TYPES> | return Es? | break i? | continue i? | goto i | fallthrough | defer E | go E | <BLOCK> | If | For | Switch | select <COMMS> | i ':' Stmt1
If: if Head <BLOCK> | if Head <BLOCK> else If | if Head <BLOCK> else <BLOCK>
Head: E | Simple? ';' E
For: for <BLOCK> | for E <BLOCK> | for Simple? ';' E? ';' Simple? <BLOCK> | for Ids d range E <BLOCK> | for Es '=' range E <BLOCK> | for range E <BLOCK>
Switch: switch SHead? <CASES> | switch TSHead <CASES>
SHead: Simple | Simple? ';' Simple?
TSHead: TSGuard | Simple ';' TSGuard
TSGuard: P '.' <SWITCHTYPE> | i d P '.' <SWITCHTYPE>
Cases: | ';' Cases | case Es ':' Block Cases | case Ts ':' Block Cases | default ':' Block Cases
Comms: | ';' Comms | case Comm ':' Block Comms | default ':' Block Comms
Comm: E w E | E | Es '=' E | Ids d E
Ts: T | T ',' Ts
File: Skip package i FileEnd
Skip: | ';' Skip
FileEnd: ';' Tops | eof
Tops: | Top Tops
Top: ';' | Top1 ';' | Top1 eof
Top1: import Imp | import <IMPORTS> | var VarS | var <VARS> | const ConstS | const <CONSTS> | type TypeS | type <TYPES> | func i <TPARAMS>? <PARAMS> Result? <BLOCK>? | func <PARAMS> i <PARAMS> Result? <BLOCK>?
""",
}

def _parameters(p: str, annotation: str, star: str) -> str:
    """Parameter lists: plain ones, defaults, / and * each once and in order, ** last. p prefixes the rules' names."""
    text = """
Params: | L1 | L2 | LS
One: Id {a}
Def: Id {a} '=' Test
L1: One | One ',' | One ',' L1 | One ',' L2 | One ',' LS | One ',' '/' S1
L2: Def | Def ',' | Def ',' L2 | Def ',' LS | Def ',' '/' S2
S1: | ',' | ',' M1 | ',' M2 | ',' LS
S2: | ',' | ',' M2 | ',' LS
M1: One | One ',' | One ',' M1 | One ',' M2 | One ',' LS
M2: Def | Def ',' | Def ',' M2 | Def ',' LS
LS: '*' Id {s} KS | '*' ',' K1 | LK
KS: | ',' | ',' K1 | ',' LK
K1: KP | KP ',' | KP ',' K1 | KP ',' LK
KP: One | Def
LK: x Id {a} | x Id {a} ','
"""
    names = "Params One Def L1 L2 S1 S2 M1 M2 LS KS K1 KP LK".split()
    words = [p + w if w.rstrip(":") in names else w for w in text.replace("{a}", annotation).replace("{s}", star).replace("\n", " \n ").split(" ")]
    return " ".join(words)


_PY_STRING = r'[rRbBuUfFtT]{0,2}(?:"""(?:[^\\]|\\[\s\S])*?"""|\'\'\'(?:[^\\]|\\[\s\S])*?\'\'\'|"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\')'
LANGUAGES["python"] = {
    "keywords": "if elif else for while try except finally with def class return break continue pass raise import from as global nonlocal del assert yield lambda not and or in is async await None True False".split(),
    "contextual": "match case type".split(),
    "operators": PY_OPERATORS,
    "names": rf"(?![rRbBuUfFtT]{{1,2}}[\"'])(?:{NAME})",
    "blanks": r"[^\S\n]",
    "lexer": _PY_STRING + r"|#[^\n]*|\\\n|\n(?:[ \t\f]*(?:#[^\n]*)?\n)*[ \t\f]*" + rf"|{NAME}|(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*(?=[eE]))(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|(?:[1-9](?:_?\d)*|0(?:_?0)*)|\d(?:_?\d)*(?=[jJ]))[jJ]?(?![^\W_])",
    "(": {"ARGS": "Args", "PARAMS": "Params", "TUPLE": "Paren", "GEN": "GenExp", "IDS": "Names", "WITH": "Withs", "TGT": "ParenTgt", "SINGLE": "Single", "DEL": "ParenDel", "PAT": "ParenPat", "PATARGS": "PatArgs"},
    "[": {"LIST": "List", "INDEX": "Index", "TGT": "ListTgt", "DEL": "ParenDel", "PAT": "ListPat", "TPARAMS": "TParams"},
    "{": {"DICT": "Dict", "PAT": "MapPat"},
    "\n": {"BLOCK": "Stmts", "CASES": "Cases"},
    "starts": ("File",),
    "islands": ("Stmt", "Case"),
    "stops": "\n" + BRACES,
    "grammar": """
File: Stmts | eof
Stmts: Stmt | Stmt Stmts
Stmt: Simple nl | Compound
Suite: Simple nl | nl <BLOCK>
Simple: Small | Small ';' | Small ';' Simple
Small: Exprs | Yield | Assign | Single ':' Test | Single ':' Test '=' Value | Single a Value | return Exprs? | break | continue | pass | raise | raise Test | raise Test from Test | import Aliases | from Path import From | from Dots Path? import From | global Ids | nonlocal Ids | del Dels | assert Test | assert Test ',' Test | type Id <TPARAMS>? '=' Test
Value: Exprs | Yield
Assign: Tgts '=' Value | Tgts '=' Assign
Yield: yield Exprs? | yield from Test
Tgts: Tgt | Tgt ',' | Tgt ',' Tgts
Tgt: T1 | '*' T1
T1: Id | P '.' Id | P <INDEX> | <TGT>
ParenTgt: | Tgts
ListTgt: | Tgts
Single: Id | P '.' Id | P <INDEX> | <SINGLE>
Dels: Del | Del ',' | Del ',' Dels
Del: Id | P '.' Id | P <INDEX> | <DEL>
ParenDel: | Dels
Test: Or | Or if Or else Test | lambda LParams ':' Test
Named: Test | Id d Test
Or: And | And or Or
And: Not | Not and And
Not: Cmp | not Not
Cmp: E | E Op Cmp
Op: '<>' | b | in | not in | is | is not
E: U | E Bin U
Bin: '+-*/%&|^@' | b | x
U: P | '+-~' U | await P
P: Id | n | S | v | None | True | False | <TUPLE> | <GEN> | <LIST> | <DICT> | P <ARGS> | P <GEN> | P <INDEX> | P '.' Id
S: s | s S
Id: i
Item: Test | '*' E
Exprs: Item | Item ',' | Item ',' Exprs
NItem: Named | '*' E
NItems: NItem | NItem ',' | NItem ',' NItems
Paren: | Yield | Named | NItem ',' | NItem ',' NItems
Comp: async? for Tgts in Or Conds? | async? for Tgts in Or Conds? Comp
Conds: if CTest | if CTest Conds
CTest: Or
GenExp: Named Comp
Args: | A1 | A2 | A3
A1: Pos | Pos ',' | Pos ',' A1 | Pos ',' A2 | Pos ',' A3
Pos: Named | '*' Test
A2: K2 | K2 ',' | K2 ',' A2 | K2 ',' A3
K2: Id '=' Test | '*' Test
A3: K3 | K3 ',' | K3 ',' A3
K3: x Test | Id '=' Test
List: | NItems | Named Comp
Index: Sub | Sub ',' | Sub ',' Index
Sub: Named | '*' E | Test? ':' Test? | Test? ':' Test? ':' Test?
Dict: | DItems | NItems | Test ':' Test Comp | Named Comp
DItems: DItem | DItem ',' | DItem ',' DItems
DItem: Test ':' Test | x E
Ann: | ':' Test
SAnn: | ':' Item
Path: Id | Path '.' Id
Alias: Path | Path as Id
Aliases: Alias | Alias ',' Aliases
Names: Name | Name ',' | Name ',' Names
Name: Id | Id as Id
Ids: Id | Id ',' Ids
Dots: Dot | Dot Dots
Dot: '.' | v
From: '*' | NamesX | <IDS>
NamesX: Name | Name ',' NamesX
Compound: Def | Deco+ Def | If | Loop | Try | With | Match
Deco: '@' Named nl
Def: async? def Id <TPARAMS>? <PARAMS> Ret? ':' Suite | class Id <TPARAMS>? <ARGS>? ':' Suite
TParams: TParam | TParam ',' | TParam ',' TParams
TParam: Id Ann | Id Ann '=' Test | '*' Id | '*' Id '=' Item | x Id | x Id '=' Test
Ret: r Test
If: if Named ':' Suite Elifs
Elifs: | elif Named ':' Suite Elifs | else ':' Suite
Else: else ':' Suite
Loop: while Named ':' Suite Else? | async? for Tgts in Exprs ':' Suite Else?
Try: try ':' Suite Except+ Else? Finally? | try ':' Suite Finally
Except: except ':' Suite | except '*'? Test ':' Suite | except '*'? Test as Id ':' Suite | except '*'? Test ',' Tests ':' Suite
Tests: Test | Test ',' Tests
Finally: finally ':' Suite
With: async? with Withs1 ':' Suite | async? with <WITH> ':' Suite
Withs1: WItem | WItem ',' Withs1
Withs: WItem | WItem ',' | WItem ',' Withs
WItem: Test | Test as T1
Match: match Subject ':' nl <CASES>
Subject: Named | NItem ',' | NItem ',' NItems
Cases: Case | Case Cases
Case: case TopPat Guard? ':' Suite
Guard: if Named
TopPat: Pat | SPat ',' | SPat ',' SPats
SPats: SPat | SPat ',' | SPat ',' SPats
SPat: Pat | '*' Id
Pat: OrPat | OrPat as Id
OrPat: Pat1 | Pat1 '|' OrPat
Pat1: Num | S | None | True | False | Path | <PAT> | Path <PATARGS>
Num: '-' n | n | '-' n '+-' n | n '+-' n
ParenPat: | Pat | SPat ',' | SPat ',' SPats
ListPat: | SPats
MapPat: | MItems
MItems: MItem | MItem ',' | MItem ',' MItems
MItem: MKey ':' Pat | x Id
MKey: Num | S | None | True | False | Path '.' Id
PatArgs: | PA1 | PA2
PA1: Pat | Pat ',' | Pat ',' PA1 | Pat ',' PA2
PA2: Id '=' Pat | Id '=' Pat ',' | Id '=' Pat ',' PA2
Field: Exprs | Yield | Named
""" + _parameters("", "Ann", "SAnn") + _parameters("L", "", ""),
}

_RUBY_RESERVED = "if elsif else unless while until for in do end def class module return break next redo retry yield begin rescue ensure case when then and or not self nil true false super alias undef defined".split()
#: Behind these, `if` and the like are modifiers, which open no block.
_RB_OPERAND = r"insC\U000f1000-\U000fffff@end@self@nil@true@false@super@return@break@next@redo@retry@yield"
_INTERP = r"(?:[^{q}\\#]|\\[\s\S]|#(?!\{{)|#\{{(?:[^{{}}{q}]|\"(?:[^\"\\{{}}]|\\.)*\"|\{{[^{{}}]*\}})*\}})*"
_RB_DQ, _RB_BT = '"' + _INTERP.format(q='"') + '"', "`" + _INTERP.format(q="`") + "`"
LANGUAGES["ruby"] = {
    "keywords": _RUBY_RESERVED,
    "contextual": [],
    "operators": RUBY_OPERATORS,
    "names": r"(?!__END__)[^\W\d]\w*[?!]?(?!=[^=~>])",
    "lexer": r"^=begin\b[\s\S]*?^=end\b[^\n]*|^__END__\n[\s\S]*|<<[~-]?(['\"`]?)([A-Za-z_]\w*)\1[^\n]*\n(?:[\s\S]*?\n)??[ \t]*\2\b(?=\s|\Z)|#[^\n]*|" + _RB_DQ + r"|'(?:[^'\\]|\\[\s\S])*'|" + _RB_BT + r"|%[wWiIqQrx]?(?:\((?:[^()]|\([^()]*\))*\)|\[(?:[^\[\]]|\[[^\[\]]*\])*\]|\{(?:[^{}]|\{[^{}]*\})*\}|<[^>]*>|\|[^|]*\||![^!]*!)[a-z]*|(?=[ \t]*/)(?:(?<=[=(,~&|\[{!;])|(?<=[=(,~&|\[{!;?:] )|(?<=\bif )|(?<=\bwhen )|(?<=\bunless )|(?<=\band )|(?<=\bor )|(?<=\breturn )|(?<=\n)|(?<=match\())[ \t]*/(?![ =])(?:[^/\\\n]|\\.)+/[a-z]*|(?=/)(?<=\w )/(?! )(?:[^/\\\n]|\\.)+/[a-z]*|(?<![\w:)\]]):(?:[A-Za-z_]\w*[?!=]?(?![=~>])|[A-Za-z_]\w*[?!]?|" + _RB_DQ + r"|'(?:[^'\\]|\\.)*'|\[\]=?|[+\-*/%<>=~!^&|]{1,3}@?)|(?:@@?|\$)?[^\W\d]\w*[?!]?(?!=[^=~>])|[^\W\d]\w*|\$[\d!@&~;,./<>_*$?:\"]|\?[^\s\w](?!\w)|\?[A-Za-z](?!\w)|" + rf"{NUMBER}r?i?|\n|\\\n",
    "newlines": True,
    "(": {"ARGS": "Args", "PARAMS": "Params", "STMTS": "Stmts", "PAT": "Pats", "MLHS": "Mlhs"},
    "[": {"INDEX": "Args", "PAT": "Pats"},
    "{": {"HASH": "Hash", "BLOCK": "BraceBlock", "PAT": "HPats"},
    "starts": ("File",),
    "islands": ("Stmt",),
    "stops": ";\n",
    "blocks": r"((?<![.qc@def])(?:@class|@module|@case|@begin|@do|@for[^\n;@do]*@do?|@def(?!(?:[i@self]\.)?i(?:=[^\U000f1000-\U000fffff]|[\U000f1000-\U000fffff]=)))(?!:)|(?<![.qc" + _RB_OPERAND + r"@def])(?<![.qc][\s\S])(?:@if|@unless|(?:@while|@until)[^\n;@do]*@do?)(?!:))|((?<![.qc@def])@end(?!:))|[;\n]",
    "grammar": """
T: nl | ';'
Ts: | T Ts
Stmts: | T Stmts | Stmt | Stmt T Stmts
File: Stmts
Stmt: Expr | Stmt Mod | Stmt rescue Expr
Mod: if Expr | unless Expr | while Expr | until Expr
Expr: Expr1 | Expr and Ts Expr1 | Expr or Ts Expr1
Expr1: E | Cmd | not Expr1 | '!' Cmd | Multi '=' Rhs | Lhs '=' Rhs | Lhs a Rhs | return Args1? | break Args1? | next Args1? | redo | retry | alias AName AName | undef Names | E k Pat | E in Pat
AName: Meth | s
Names: AName | AName ',' Names
Rhs: Assigned | Arg ',' Args1 | '*' E
Assigned: Cmd | not Expr1 | '!' Cmd | Lhs '=' Rhs | Lhs a Rhs | E
Lhs: i | P '.' i | P q i | P <INDEX> | P c i | c i | self '.' i
Multi: MItem ',' | MItem ',' Multi1 | '*' Lhs | '*' | <MLHS> ','
Multi1: MItem | MItem ',' Multi1
MItem: Lhs | '*' Lhs | '*' | <MLHS> | x
Mlhs: Multi1
E: R | R '?' E ':' E | Lhs '=' E | Lhs a E
R: U | R Bin U | R v | v U | defined P | R Bin Lhs '=' E | R Bin Lhs a E
Bin: '+-*/%&|^<>' | b | v | o | x
U: P | Pre U | Lambda
Pre: '+-!~' 
Lambda: r LParams? <BLOCK> | r LParams? do Body end
LParams: <PARAMS> | Params1
P: i | n | Strs | self | nil | true | false | super | yield | retry | redo | <ARGS> | <STMTS> | <INDEX> | <HASH> | P <ARGS> | P <INDEX> | P '.' Meth | P q Meth | P '.' <ARGS> | P c Meth | c i | P <BLOCK> | P do DoPipes? Body end | Construct | Lambda | not <ARGS> | yield <ARGS> | super <ARGS> | return | break | next
Do: do DoPipes? Body end
DoPipes: '|' Params? '|' | o | '|' Params? ';' Params '|'
Strs: s | s Strs
Meth: i | Any
Construct: if Expr Then Stmts end | if Expr Then Stmts Elsifs end | unless Expr Then Stmts end | unless Expr Then Stmts Elsifs end | while Expr Dos Stmts end | until Expr Dos Stmts end | for ForVars in Expr Dos Stmts end | case Expr? Ts Whens end | case Expr? Ts Whens else Stmts end | case Expr Ts Ins end | case Expr Ts Ins else Stmts end | def DName DParams Body end | def DName <PARAMS>? '=' Ts Stmt | begin Body end | class Path Super? T Body end | class b Expr T Body end | module Path Body end
Super: '<' Expr
ForVars: MItem | MItem ',' ForVars
Then: T Ts ThenW? | then | 
ThenW: then
Dos: T | do | T do
Elsifs: else Stmts | elsif Expr Then Stmts | elsif Expr Then Stmts Elsifs
Whens: When | When Whens
When: when Args1 Then Stmts
Ins: In | In Ins
In: in TopPat Guard? Then Stmts
Guard: if Expr | unless Expr
Body: Stmts | Stmts Rescues
Rescues: Rescue | Rescue Rescues | else Stmts | else Stmts Ensure | Ensure
Rescue: rescue Excs? ExcTo? Then Stmts
Excs: Args1
ExcTo: k Lhs
Ensure: ensure Stmts
DParams: <PARAMS> | Params1 T | T | <PARAMS> T | 
DName: Meth | Op | self '.' Meth | i '.' Meth | self '.' Op | DName0 '='
DName0: Meth | self '.' Meth
Op: '+-*/%<>!~^&|' | b | <INDEX> | <INDEX> '=' | p | x | '+-!~' '@' | a | o
Path: i | Path c i | c i
Any: @ANY@
Args: | Arg | Arg ',' | Arg ',' Args | Ts
Arg: E | '*' E | '*' | '&' E | '&' | x E | x | Label Ts E | Label | Strs ':' Ts E | E k Ts E | v | Cmd | not Expr1
Label: i ':' | Any ':'
Args1: Arg | Arg ',' Args1
Cmd: Callee Args1 | Callee Args1 Do | Cmd '.' Meth | Cmd '.' Meth <ARGS> | R Bin Cmd | Cmd q Meth
Callee: i | P '.' Meth | P q Meth | P c i | yield | super
Hash: | HItem | HItem ',' | HItem ',' Hash
HItem: Label E | Label | Strs ':' E | E k E | x E | x
Params: | Ts | Param | Param ',' | Param ',' Params
Params1: Param | Param ',' Params1
Param: i | i '=' E | i ':' | i ':' E | '*' i? | x i? | x nil | '&' i? | <PARAMS> | v | <MLHS>
BraceBlock: Pipes? Stmts
Pipes: '|' Params? '|' | o | '|' Params? ';' Params '|'
TopPat: Pat | Pats1 | HPats1
Pats1: PItem ',' | PItem ',' Pats1 | PItem | '*' i?
Pats: | PItem | PItem ',' | PItem ',' Pats | HPats1
PItem: Pat | '*' i?
Pat: Pat1 | Pat '|' Pat1 | Pat k i
Pat1: U | v U | U v U? | Path | Path <PAT> | <PAT> | '^' i | '^' <ARGS> | nil | Lambda
HPats: HPats1 |
HPats1: HPat | HPat ',' | HPat ',' HPats1
HPat: Label Pat? | Strs ':' Pat? | x i | x nil
""".replace("@ANY@", " | ".join(_RUBY_RESERVED)),
}

_WORD_CHAR = r"[^\s;&|<>()\"'`$\\]"
_SUB = r"\$\(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\)|\$\((?:[^()\"'\\]|\\[\s\S]|\"(?:[^\"\\]|\\[\s\S])*\"|'[^']*'|\((?:[^()]|\([^()]*\))*\))*\)|\$\{(?:[^{}]|\{[^{}]*\})*\}|`[^`]*`|\$[\w@*#?$!-]"
_PART = rf"(?:{_SUB}|\\[\s\S]|\$?\"(?:{_SUB}|[^\"\\]|\\[\s\S])*\"|\$'(?:[^'\\]|\\[\s\S])*'|'[^']*'|\$|{_WORD_CHAR})"
_SH_RESERVED = "if then elif else fi for while until do done case esac in function select time coproc".split()
LANGUAGES["bash"] = {
    "keywords": _SH_RESERVED,
    "contextual": [],
    "operators": {"&&": "b", "||": "b", "|&": "b", "|": "b", ";;": "t", ";&": "t", ";;&": "t", "{": "{", "}": "}", "!": "!"},
    "lexer": rf"<<-?[ \t]*(['\"\\]?)(\w+)\1[^\n]*\n(?:[\s\S]*?\n)??[ \t]*\2(?=\n|\Z)|(?<![^\s;&|()])#[^\n]*|\\\n|\[\[(?=\s)(?:\s(?:{_PART}|&&|\|\||[()<>|&\s])*?)\s\]\](?=[\s;&|)]|\Z)|\(\((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\)\)|(?:\{{\w+\}}|\d*)(?:<<<|>>|<&|>&|<>|>\||&>>|&>|(?<![^\s=]) ?[<>]\((?:[^()]|\([^()]*\))*\)|<|>)|\w+(?:\[[^\]\n]*\])?\+?=\((?:{_PART}|\s|[()]|#[^\n]*\n)*?\)(?=[\s;&|)]|\Z)|;;&|;;|;&|&&|\|\||\|&|{_PART}+|\n|[;&|()]",
    "newlines": True,
    "starts": ("File",),
    "islands": ("AndOr",),
    "stops": ";\n",
    "blocks": r"((?<![isgdh])(?:@if|@case|@do)|\{)|((?<![isgdh])(?:@fi|@esac|@done|\}))|[;\n]",
    "grammar": """
Word: i | s | Key
Key: if | then | elif | else | fi | for | while | until | do | done | case | esac | in | function | select | time | coproc | '{}!'
NLs: | nl NLs
File: NLs List0
List0: | AndOr NLs | AndOr Sep NLs List0
List: NLs AndOr Sep NLs Lists
Lists: | AndOr Sep NLs Lists
Sep: ';' | '&' | nl
AndOr: Pipe | Pipe b NLs AndOr
Pipe: '!' Pipe | time Pipe | Cmd | coproc Cmd
Cmd: Simple | Compound Redir* | Fun
Redir: h Word | g | w
Simple: First Rest
First: i | s | Redir | Redir First
Rest: | Word Rest | Redir Rest
Fun: i '(' ')' NLs Compound Redir* | function Word NLs Compound Redir* | function Word '(' ')' NLs Compound Redir*
Compound: '{' List '}' | '(' Sub ')' | if List Then | For Do | while List Do | until List Do | case Word NLs in NLs Arms esac | d
Sub: NLs Sub1
Sub1: AndOr NLs | AndOr Sep NLs | AndOr Sep NLs Sub1
Then: then List fi | then List else List fi | then List elif List Then
Do: do List done
For: for i End | for i NLs in Words SepN | for d End | select i NLs in Words SepN | select i End
End: NLs | ';' NLs
SepN: ';' NLs | nl NLs
Words: | Word Words
Arms: | LastArm | Arm NLs Arms
Arm: ArmHead ArmBody t
LastArm: ArmHead ArmBody NLs
ArmHead: Alts ')' | '(' Alts ')'
ArmBody: NLs | NLs ArmList
ArmList: AndOr NLs | AndOr Sep NLs | AndOr Sep NLs ArmList
Alts: Word | Word b Alts
""",
}

#: Names under which the languages are written, and extensions of paths.
ALIASES = {"c": "c", "h": "c", "cs": "csharp", "csharp": "csharp", "c#": "csharp", "go": "go", "golang": "go", "java": "java", "js": "javascript", "javascript": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "py": "python", "python": "python", "python3": "python", "pyi": "python", "rb": "ruby", "ruby": "ruby", "rs": "rust", "rust": "rust", "sh": "bash", "bash": "bash", "shell": "bash", "ts": "typescript", "typescript": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript"}
