"""Grammars of the languages of source files.

Expressions are flat (operands joined by operators): precedence shapes a tree but never decides whether a text parses.
Where a language has a long tail of rare forms the rules lean to accepting.
"""

from __future__ import annotations

from functools import lru_cache

from lumenveil.llm.syntax import lexers, yaml
from lumenveil.llm.syntax.chart import Parser, Tokens
from lumenveil.llm.syntax.grammar import compile_grammar

JSON = """
Doc = Value
Value = STR | VALUE | '{' [Pair {',' Pair}] '}' | '[' [Value {',' Value}] ']'
Pair = STR ':' Value
"""

PYTHON = """
File = {Stmt}
Stmt = Simple | Compound
Simple = Small {';' Small} [';'] NEWLINE
Small = ExprStmt | 'pass' | 'break' | 'continue' | 'return' [Stars] | 'raise' [Test ['from' Test]] | ('global' | 'nonlocal') ID {',' ID}
  | 'del' Stars | 'assert' Test [',' Test] | Import | 'type' ID [TypeParams] '=' Test
ExprStmt = (Stars | Yield) [':' Test ['=' (Stars | Yield)] | Aug (Stars | Yield) | '=' (Stars | Yield) {'=' (Stars | Yield)}]
Aug = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
Yield = 'yield' ['from' Test | Stars]
Import = 'import' Dotted ['as' ID] {',' Dotted ['as' ID]}
  | 'from' (Dotted | ('.' | '...') {'.' | '...'} [Dotted]) 'import' ('*' | Named_as {',' Named_as} | '(' Named_as {',' Named_as} [','] ')')
Named_as = ID ['as' ID]
Dotted = ID {'.' ID}
Compound = If | While | For | Try | With | Def | Class | 'async' (For | With | Def) | Decorated | Match
Suite = Simple | NEWLINE INDENT Stmt {Stmt} DEDENT
If = 'if' Named ':' Suite {'elif' Named ':' Suite} ['else' ':' Suite]
While = 'while' Named ':' Suite ['else' ':' Suite]
For = 'for' Targets 'in' Stars ':' Suite ['else' ':' Suite]
Try = 'try' ':' Suite (Except {Except} ['else' ':' Suite] ['finally' ':' Suite] | 'finally' ':' Suite)
Except = 'except' ['*'] [Test {',' Test} ['as' ID]] ':' Suite
With = 'with' (WithItem {',' WithItem} | '(' WithItem {',' WithItem} [','] ')') ':' Suite
WithItem = Test ['as' Target]
Def = 'def' ID [TypeParams] '(' [Params] ')' ['->' Test] ':' Suite
Class = 'class' ID [TypeParams] ['(' [Args] ')'] ':' Suite
Decorated = '@' Named NEWLINE {'@' Named NEWLINE} (Def | Class | 'async' Def)
Match = 'match' Stars ':' NEWLINE INDENT Case {Case} DEDENT
Case = 'case' Pattern {',' Pattern} [','] ['if' Named] ':' Suite
Pattern = Star ['as' ID]
TypeParams = '[' TypeParam {',' TypeParam} [','] ']'
TypeParam = ['*' | '**'] ID [':' Test] ['=' Star]
Params = Param {',' Param} [',']
Param = ID [':' Star] ['=' Test] | '*' [ID [':' Star]] | '**' ID [':' Test] | '/'
Named = Test [':=' Test]
Star = '*' Or | Named
Stars = Star {',' Star} [',']
Test = Or ['if' Or 'else' Test] | 'lambda' [LambdaParam {',' LambdaParam} [',']] ':' Test
LambdaParam = ID ['=' Test] | '*' [ID] | '**' ID | '/'
Or = Operand {Op Operand}
Op = 'or' | 'and' | 'in' | 'not' 'in' | 'is' ['not'] | '<' | '>' | '<=' | '>=' | '==' | '!=' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '&' | '|' | '^' | '<<' | '>>' | '**'
Operand = {'not' | '-' | '+' | '~' | 'await'} Atom {Trailer}
Target = ['*'] Atom {Trailer}
Targets = Target {',' Target} [',']
Atom = ID | NUM | STR {STR} | '...' | 'None' | 'True' | 'False' | '(' [Yield | Args] ')' | '[' [Star (CompFor {CompFor} | {',' Star} [','])] ']'
  | '{' [DictItem (CompFor {CompFor} | {',' DictItem} [',']) | Star (CompFor {CompFor} | {',' Star} [','])] '}'
DictItem = Test ':' Test | '**' Or
CompFor = ['async'] 'for' Targets 'in' Or {'if' (Or [':=' Or] | 'lambda' [LambdaParam {',' LambdaParam}] ':' Test)}
Trailer = '.' ID | '(' [Args] ')' | '[' Slice {',' Slice} [','] ']'
Args = Arg (CompFor {CompFor} | {',' Arg} [','])
Arg = Named [CompFor {CompFor}] | ID '=' Test | '*' Test | '**' Test
Slice = Star | [Test] ':' [Test] [':' [Test]]
"""

_ECMA = """
Program = {Statement}
Statement = Block | Variable END | 'if' '(' Expr ')' Statement ['else' Statement] | For | 'while' '(' Expr ')' Statement
  | 'do' Statement 'while' '(' Expr ')' [';'] | 'return' [~sameline Expr] END | ('break' | 'continue') [~sameline ID] END | 'throw' Expr END
  | 'try' Block ('catch' ['(' Binding [Typed] ')'] Block ['finally' Block] | 'finally' Block) | Switch | Function | {Decorator} ['abstract'] Class
  | Import | Export | ';' | ID ':' Statement | ~nobrace Expr END | 'debugger' END | 'with' '(' Expr ')' Statement | Extra
END = ';' | ~asi
Block = '{' {Statement} '}'
Variable = ('var' | 'let' | 'const' | 'await' 'using' | 'using') Declarator {',' Declarator}
Declarator = Binding ['!'] [Typed] ['=' Assign]
Binding = ID | '[' {','} [Element {',' {','} Element} {','}] ']' | '{' [Property {',' Property} [',']] '}'
Element = ['...'] Binding ['=' Assign]
Property = '...' Binding | ID ['=' Assign] | Key ':' Binding ['=' Assign]
Key = NAME | STR | NUM | '[' Assign ']'
For = 'for' ['await'] '(' (([Variable | Expr] ';' [Expr] ';' [Expr]) | (('var' | 'let' | 'const') Binding | Postfix | Binding) ('of' | 'in') Expr) ')' Statement
Switch = 'switch' '(' Expr ')' '{' {('case' Expr | 'default') ':' {Statement}} '}'
Function = ['async'] 'function' ['*'] [ID] Signature (Block | Absent)
Signature = [TypeParams] '(' [Params] ')' [Returned]
Params = Param {',' Param} [',']
Param = {Decorator} {Modifier} ['...'] Binding ['?'] [Typed] ['=' Assign]
Class = 'class' [ID [TypeParams]] ['extends' Postfix] [Implements] '{' {Member} '}'
Member = ';' | 'static' Block | {Decorator} {Modifier} (Key | '*' Key | 'async' ['*'] Key | ('get' | 'set') Key) (Signature (Block | Absent) | ['?' | '!'] [Typed] ['=' Assign] END) | Index END
Modifier = 'static' | Visible
Decorator = '@' Postfix
Import = 'import' (STR | Clause 'from' STR) [('with' | 'assert') Object] END | ImportExtra
Clause = ID [',' (Names | '*' 'as' ID)] | Names | '*' 'as' ID
Names = '{' [Specifier {',' Specifier} [',']] '}'
Specifier = (NAME | STR) ['as' (NAME | STR)] | TypeName
Export = 'export' (('*' ['as' (NAME | STR)] 'from' STR [('with' | 'assert') Object] | Names ['from' STR [('with' | 'assert') Object]]) END | Variable END | Function | {Decorator} ['abstract'] Class
  | 'default' (Function | {Decorator} ['abstract'] Class | ~nofun Assign END) | ExportExtra) | Decorator {Decorator} 'export' ['default'] ['abstract'] Class
Expr = Assign {',' Assign}
Assign = Operand {Op Operand} ['?' Assign ':' Assign] | 'yield' ['*'] [~sameline Assign]
Op = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' | '==' | '!=' | '===' | '!==' | '<' | '<=' | '>' ['='] | '>' '>' ['>'] ['=']
  | '<<' | '+' | '-' | '*' | '/' | '%' | '**' | '&' | '|' | '^' | '&&' | '||' | '??' | 'in' | 'instanceof'
Operand = {'!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new'} Postfix | Arrow | Cast Operand
Arrow = ['async' ~sameline] (ID | Signature) '=>' (Block | ~nobrace Assign | Function | Class)
Postfix = Primary {'.' NAME | '?.' (NAME | '[' Expr ']' | Arguments) | '[' Expr ']' | Arguments | Template | ~sameline ('++' | '--') | Suffix}
Primary = ID | NUM | STR | REGEX | Template | 'this' | 'null' | 'true' | 'false' | 'super' | 'new' '.' NAME | 'import' ('(' Assign [',' Assign] [','] ')' | '.' NAME) | Array | Object | '(' Expr ')' | Function | {Decorator} Class
Array = '[' {','} [Spread {',' {','} Spread} {','}] ']'
Spread = ['...'] Assign
Arguments = '(' [Spread {',' Spread} [',']] ')'
Template = TPL | TPL_HEAD Expr {TPL_MIDDLE Expr} TPL_TAIL
Object = '{' [ObjectItem {',' ObjectItem} [',']] '}'
ObjectItem = '...' Assign | ID ['=' Assign] | Key ':' Assign | ['async'] ['*'] Key Signature Block | ('get' | 'set') Key Signature Block
"""

JAVASCRIPT = _ECMA + """
Typed = NEVER
Returned = NEVER
TypeParams = NEVER
Implements = NEVER
Visible = 'accessor'
Index = NEVER
Absent = NEVER
Suffix = NEVER
Cast = NEVER
Extra = NEVER
TypeName = NEVER
ImportExtra = NEVER
ExportExtra = NEVER
"""

TYPESCRIPT = _ECMA + """
Typed = ':' Type
Returned = ':' (Type | 'asserts' (ID | 'this') ['is' Type])
TypeParams = '<' TypeParam {',' TypeParam} [','] '>'
TypeParam = {'const' | 'in' | 'out'} ID ['extends' Type] ['=' Type]
TypeArgs = '<' Type {',' Type} '>'
Implements = 'implements' Reference {',' Reference}
Visible = 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare' | 'accessor'
Index = {Modifier} '[' ID ':' Type ']' ':' Type
Absent = END
Suffix = '!' | ~sameline ('as' | 'satisfies') ('const' | Type) | TypeArgs
Cast = '<' ('const' | Type) '>'
Extra = Interface | Alias | Enum | Namespace | 'declare' (Variable END | Function | ['abstract'] Class | Interface | Alias | Enum | Namespace | 'global' Block)
Interface = 'interface' ID [TypeParams] ['extends' Reference {',' Reference}] Members
Alias = 'type' ID [TypeParams] '=' Type END
Enum = ['const'] 'enum' ID '{' [EnumItem {',' EnumItem} [',']] '}'
EnumItem = Key ['=' Assign]
Namespace = ('namespace' | 'module') (ID {'.' NAME} | STR) (Block | END)
TypeName = 'type' (NAME | STR) ['as' (NAME | STR)]
ImportExtra = 'import' 'type' Clause 'from' STR [('with' | 'assert') Object] END | 'import' ['type'] ID '=' ('require' '(' STR ')' | ID {'.' NAME}) END
ExportExtra = Interface | Alias | Enum | Namespace | 'type' (Names ['from' STR] | '*' ['as' NAME] 'from' STR) END | '=' Expr END | 'as' 'namespace' ID END | 'declare' (Variable END | Function | ['abstract'] Class | Interface | Alias | Enum | Namespace)
  | 'default' Interface | ImportExtra
Type = Union ['extends' Union '?' Type ':' Type] | FunctionType
Union = ['|' | '&'] Unary {('|' | '&') Unary}
Unary = {'keyof' | 'unique' | 'readonly' | 'infer'} (Basic {~sameline '[' [Type] ']'} | 'typeof' (ID | 'this' | 'import' '(' STR ')') {'.' NAME} [TypeArgs] {'[' [Type] ']'}) | FunctionType
FunctionType = ['abstract'] ['new'] [TypeParams] '(' [Params] ')' '=>' (Type | 'asserts' ID ['is' Type])
Basic = Reference | ID 'is' Type | 'this' ['is' Type] | STR | ['-'] NUM | 'null' | 'void' | 'true' | 'false' | TPL | TPL_HEAD Type {TPL_MIDDLE Type} TPL_TAIL | Members | '[' [TupleItem {',' TupleItem} [',']] ']' | '(' Type ')' | 'import' '(' STR ')' {'.' NAME} [TypeArgs]
TupleItem = ['...'] [NAME ['?'] ':'] Type ['?']
Reference = ID {'.' NAME} [TypeArgs]
Members = '{' {TypeMember (';' | ',' | ~asi)} '}'
TypeMember = {'readonly' | '+' | '-' | 'static'} (Key | ('get' | 'set') Key) ['?'] (Signature | [Typed]) | ['new'] Signature | {'readonly' | '+' | '-'} '[' ID (':' Type ']' | 'in' Type ['as' Type] ']') [('+' | '-') '?' | '?'] [Typed]
"""

JAVA = """
Unit = {Annotation} ['package' QName ';'] {'import' ['static' | 'module'] QName ['.' '*'] ';' | ';'} {TypeDecl | ';'}
QName = ID {'.' ID}
TypeDecl = {Mod} TypeBody
TypeBody = Class | Interface | Enum | Record | '@' 'interface' ID '{' {Member} '}'
Mod = Annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed'
Annotation = '@' QName ['(' [AnnoItem {',' AnnoItem}] ')']
AnnoItem = [ID '='] AnnoValue
AnnoValue = Expr | Annotation | '{' [AnnoValue {',' AnnoValue}] [','] '}'
Class = 'class' ID [TypeParams] ['extends' Type] ['implements' Type {',' Type}] ['permits' Type {',' Type}] Body
Interface = 'interface' ID [TypeParams] ['extends' Type {',' Type}] ['permits' Type {',' Type}] Body
Record = 'record' ID [TypeParams] '(' [Params] ')' ['implements' Type {',' Type}] Body
Enum = 'enum' ID ['implements' Type {',' Type}] '{' [Constant {',' Constant}] [','] [';' {Member}] '}'
Constant = {Annotation} ID ['(' [Args] ')'] [Body]
Body = '{' {Member} '}'
Member = ';' | ['static'] Block | {Mod} (TypeBody | [TypeParams] (Type ID (MethodRest | Var {',' ID Var} ';') | ID MethodRest) | ID Block)
MethodRest = '(' [Params] ')' {'[' ']'} ['throws' Type {',' Type}] (Block | ';' | 'default' AnnoValue ';')
Var = {'[' ']'} ['=' Init]
Init = Expr | '{' [Init {',' Init}] [','] '}'
Params = Param {',' Param}
Param = {'final' | Annotation} Type ['...'] (ID {'[' ']'} | [ID '.'] 'this')
TypeParams = '<' {Annotation} ID ['extends' Type {'&' Type}] {',' {Annotation} ID ['extends' Type {'&' Type}]} '>'
Type = {Annotation} (Prim | ID [TypeArgs] {'.' {Annotation} ID [TypeArgs]}) {{Annotation} '[' ']'}
Prim = 'boolean' | 'byte' | 'short' | 'int' | 'long' | 'char' | 'float' | 'double' | 'void'
TypeArgs = '<' [TypeArg {',' TypeArg}] '>'
TypeArg = Type | {Annotation} '?' [('extends' | 'super') Type]
Block = '{' {BlockItem} '}'
BlockItem = Local ';' | {Mod} TypeBody | Stmt
Local = {'final' | Annotation} Type ID Var {',' ID Var}
Stmt = Block | ';' | 'if' '(' Expr ')' Stmt ['else' Stmt] | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';' | For | 'return' [Expr] ';' | 'throw' Expr ';'
  | ('break' | 'continue') [ID] ';' | 'yield' Expr ';' | Try | Switch | 'synchronized' '(' Expr ')' Block | 'assert' Expr [':' Expr] ';' | ID ':' Stmt | Expr ';'
For = 'for' '(' ({'final' | Annotation} Type ID ':' Expr | [Local | Expr {',' Expr}] ';' [Expr] ';' [Expr {',' Expr}]) ')' Stmt
Try = 'try' ['(' Resource {';' Resource} [';'] ')'] Block {'catch' '(' {'final' | Annotation} Type {'|' Type} ID ')' Block} ['finally' Block]
Resource = Local | Expr
Switch = 'switch' '(' Expr ')' '{' {Label (':' {BlockItem} | '->' (Expr ';' | Block | 'throw' Expr ';'))} '}'
Label = 'case' CaseItem {',' CaseItem} ['when' Expr] | 'default'
CaseItem = Expr | 'default' | Pattern
Pattern = {'final' | Annotation} Type (ID | '(' [Pattern {',' Pattern}] ')' [ID])
Expr = Operand {Op Operand | 'instanceof' (['final'] Type | Pattern)} ['?' Expr ':' Expr]
Op = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '==' | '!=' | '<' | '<=' | '>' ['='] | '>' '>' ['>'] ['='] | '<<' | '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||'
Operand = {'+' | '-' | '!' | '~' | '++' | '--' | '(' Type {'&' Type} ')'} (Primary {Postfix}) | Lambda | '(' Type {'&' Type} ')' Lambda
Primary = NUM | STR | 'true' | 'false' | 'null' | ID | 'this' | 'super' | '(' Expr ')' | New | Switch | Prim
New = 'new' {Annotation} (Prim | [TypeArgs] ID [TypeArgs] {'.' {Annotation} ID [TypeArgs]}) ('(' [Args] ')' [Body] | '[' [Expr] ']' {'[' [Expr] ']'} [Init])
Postfix = '.' ([TypeArgs] ID | 'class' | 'this' | 'super' | New) | '(' [Args] ')' | '[' [Expr] ']' | '++' | '--' | [TypeArgs] '::' [TypeArgs] (ID | 'new')
Args = Expr {',' Expr}
Lambda = (ID | '(' [LambdaParam {',' LambdaParam}] ')') '->' (Expr | Block)
LambdaParam = ID | Param
"""

CSHARP = """
Unit = {'extern' ID ID ';'} {['global'] Using} {Item}
Item = Namespace | {Attr} {Mod} TypeDecl | Attr | Stmt
Using = 'using' ['static' | 'unsafe'] [ID '='] Type ';'
Namespace = 'namespace' ID {'.' ID} (';' | '{' {'extern' ID ID ';'} {Using} {Namespace | {Attr} {Mod} TypeDecl} '}' [';'])
Attr = '[' [NAME ':'] AttrItem {',' AttrItem} [','] ']'
AttrItem = QName ['(' [AttrArg {',' AttrArg}] ')']
AttrArg = [ID ('=' | ':')] Expr
QName = ID ['::' ID] [TypeArgs] {'.' ID [TypeArgs]}
Mod = 'public' | 'private' | 'protected' | 'internal' | 'static' | 'abstract' | 'sealed' | 'virtual' | 'override' | 'readonly' | 'partial' | 'async' | 'unsafe' | 'extern' | 'volatile' | 'new' | 'required' | 'file' | 'ref' | 'fixed'
TypeDecl = ('class' | 'struct' | 'interface' | 'record' ['class' | 'struct']) ID [TypeParams] ['(' [Params] ')'] [':' Type ['(' [Args] ')'] {',' Type}] {Constraint} ('{' {Member} '}' [';'] | ';')
  | 'enum' ID [':' Type] '{' [EnumItem {',' EnumItem} [',']] '}' [';'] | 'delegate' Type ID [TypeParams] '(' [Params] ')' {Constraint} ';'
EnumItem = {Attr} ID ['=' Expr]
TypeParams = '<' TypeParam {',' TypeParam} '>'
TypeParam = {Attr} ['in' | 'out'] ID
Constraint = 'where' ID ':' ConstraintItem {',' ConstraintItem}
ConstraintItem = Type | 'class' ['?'] | 'struct' | 'notnull' | 'unmanaged' | 'default' | 'new' '(' ')'
Member = {Attr} {Mod} (TypeDecl | Typed | ID '(' [Params] ')' [':' ('base' | 'this') '(' [Args] ')'] FunctionBody | '~' ID '(' ')' FunctionBody
  | 'const' Type ID '=' Expr {',' ID '=' Expr} ';' | 'event' Type (ID ['=' Expr] {',' ID} ';' | QName '{' {Accessor} '}')
  | ('implicit' | 'explicit') 'operator' Type '(' Params ')' FunctionBody)
Typed = Type (MemberName [TypeParams] '(' [Params] ')' {Constraint} FunctionBody | MemberName ('{' Accessor {Accessor} '}' ['=' Expr ';'] | '=>' Expr ';') | ID ['[' Expr ']'] ['=' Init] {',' ID ['=' Init]} ';'
  | [QName '.'] 'this' '[' Params ']' ('{' Accessor {Accessor} '}' | '=>' Expr ';') | 'operator' OperatorSign '(' Params ')' FunctionBody)
MemberName = ID | QName '.' ID
OperatorSign = '+' | '-' | '!' | '~' | '++' | '--' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' ['='] | '>' '>' | '==' | '!=' | '<' | '<=' | 'true' | 'false'
Accessor = {Attr} {Mod} ('get' | 'set' | 'init' | 'add' | 'remove') FunctionBody
FunctionBody = Block | '=>' Expr ';' | ';'
Params = Param {',' Param}
Param = {Attr} {'ref' | 'out' | 'in' | 'params' | 'this' | 'scoped' | 'readonly'} Type ID ['=' Expr] | {Attr} '__arglist'
Type = ['ref' ['readonly']] (Predef | QName | '(' Type [ID] {',' Type [ID]} ')' | 'delegate' '*' ['managed' | 'unmanaged'] TypeArgs) {'?' | '*' | '[' {','} ']'}
Predef = 'bool' | 'byte' | 'sbyte' | 'char' | 'decimal' | 'double' | 'float' | 'int' | 'uint' | 'long' | 'ulong' | 'short' | 'ushort' | 'object' | 'string' | 'void'
TypeArgs = '<' [Type] {',' [Type]} '>'
Block = '{' {Stmt} '}'
Stmt = Block | ';' | Local ';' | 'const' Type ID '=' Expr {',' ID '=' Expr} ';' | LocalFunction | 'if' '(' Expr ')' Stmt ['else' Stmt] | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';'
  | 'for' '(' [Local | Expr {',' Expr}] ';' [Expr] ';' [Expr {',' Expr}] ')' Stmt | ['await'] 'foreach' '(' (Type ID | 'var' Tuple | Tuple) 'in' Expr ')' Stmt
  | 'return' ['ref'] [Expr] ';' | 'throw' [Expr] ';' | ('break' | 'continue') ';' | 'goto' (ID | 'case' Expr | 'default') ';' | 'yield' ('return' Expr | 'break') ';' | Try | Switch
  | 'lock' '(' Expr ')' Stmt | ['await'] 'using' ('(' (Local | Expr) ')' Stmt | Local ';') | 'fixed' '(' Local ')' Stmt | ('checked' | 'unchecked' | 'unsafe') Block | ID ':' Stmt | Expr ';'
Tuple = '(' TupleItem {',' TupleItem} ')'
TupleItem = ID | Type ID | Tuple
Local = ['scoped'] Type ID ['=' Init] {',' ID ['=' Init]}
Init = ['ref'] Expr | '{' [Init {',' Init} [',']] '}'
LocalFunction = {Attr} {'static' | 'async' | 'unsafe' | 'extern'} Type ID [TypeParams] '(' [Params] ')' {Constraint} FunctionBody
Try = 'try' Block ({'catch' ['(' Type [ID] ')'] ['when' '(' Expr ')'] Block} ['finally' Block])
Switch = 'switch' (Expr) '{' {('case' Pattern ['when' Expr] | 'default') ':' {Stmt}} '}'
Expr = Operand {Op Operand | 'is' Pattern | 'as' Type | 'switch' '{' [Arm {',' Arm} [',']] '}' | 'with' Braces | '..'} ['?' Expr ':' Expr] | Query
Arm = Pattern ['when' Expr] '=>' Expr
Op = '=' ['ref'] | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '??=' | '==' | '!=' | '<' | '<=' | '>' ['='] | '>' '>' ['>'] ['='] | '<<' | '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | '??' | '..'
Operand = {'+' | '-' | '!' | '~' | '++' | '--' | '&' | '*' | '^' | '..' | 'await' | '(' Type ')'} (Primary {Postfix}) | '..' | Lambda | 'throw' Expr | '(' Type ')' Lambda
Primary = NUM | STR {STR} | 'true' | 'false' | 'null' | ID ['::' ID] [TypeArgs] | 'this' | 'base' | Predef | '(' Expr ')' | '(' Arg ',' Arg {',' Arg} ')' | New | 'typeof' '(' Type ')' | 'sizeof' '(' Type ')' | 'default' ['(' Type ')']
  | ('checked' | 'unchecked') '(' Expr ')' | 'stackalloc' [Type] ['[' [Expr] ']'] [Braces] | '[' [CollectionItem {',' CollectionItem} [',']] ']'
CollectionItem = Expr
New = 'new' (QName | Predef | '(' Type {',' Type} ')' | ) {'?'} ('(' [Args] ')' [Braces] | '[' [Expr {',' Expr} | {','}] ']' {'[' {','} ']'} [Braces] | Braces)
Braces = '{' [BraceItem {',' BraceItem} [',']] '}'
BraceItem = Expr ['=' Braces] | '[' Args ']' '=' (Expr | Braces) | Braces
Postfix = ['?'] '.' ID [TypeArgs] | '->' ID | '(' [Args] ')' | ['?'] '[' Args ']' | '++' | '--' | '!'
Args = Arg {',' Arg}
Arg = [ID ':'] ['ref' | 'out' | 'in'] (Expr | Type ID)
Lambda = {Attr} {'async' | 'static'} ([Type] '(' [LambdaParam {',' LambdaParam}] ')' | ID) '=>' (Expr | Block) | ['async' | 'static'] 'delegate' ['(' [Params] ')'] Block
LambdaParam = {Attr} {'ref' | 'out' | 'in' | 'params' | 'scoped'} [Type] ID ['=' Expr]
Pattern = ['not'] PatternItem {('and' | 'or') ['not'] PatternItem}
PatternItem = Operand {'+' | '-' | '*' | '/' | '|' | '<<'} | Type [ID] | ('<' ['='] | '<=' | '>' ['=']) Operand | [Type] ['(' [[ID ':'] Pattern {',' [ID ':'] Pattern}] ')'] PropertyPattern [ID] | [Type] '(' [[ID ':'] Pattern {',' [ID ':'] Pattern}] ')' [ID] | 'var' Tuple | '[' [ListItem {',' ListItem} [',']] ']' [ID]
ListItem = Pattern | '..' [Pattern]
PropertyPattern = '{' [ID {'.' ID} ':' Pattern {',' ID {'.' ID} ':' Pattern} [',']] '}'
Query = From {From | 'where' Expr | 'let' ID '=' Expr | 'join' [Type] ID 'in' Expr 'on' Expr 'equals' Expr ['into' ID] | 'orderby' Expr ['ascending' | 'descending'] {',' Expr ['ascending' | 'descending']}} ('select' Expr | 'group' Expr 'by' Expr) ['into' ID {From | 'where' Expr} ('select' Expr | 'group' Expr 'by' Expr)]
From = 'from' [Type] ID 'in' Expr
"""

GO = """
File = 'package' ID ';' {Import ';'} {Top ';'}
Import = 'import' (Spec | '(' [Spec {';' Spec} [';']] ')')
Spec = ['.' | ID] STR
Top = Decl | Func
Decl = 'const' (ConstSpec | '(' [ConstSpec {';' ConstSpec} [';']] ')') | 'var' (VarSpec | '(' [VarSpec {';' VarSpec} [';']] ')') | 'type' (TypeSpec | '(' [TypeSpec {';' TypeSpec} [';']] ')')
ConstSpec = ID {',' ID} [[Type] '=' Exprs]
VarSpec = ID {',' ID} (Type ['=' Exprs] | '=' Exprs)
TypeSpec = ID [TypeParams] ['='] Type
TypeParams = '[' ID {',' ID} Constraint {',' ID {',' ID} Constraint} [','] ']'
Constraint = ['~'] Type {'|' ['~'] Type}
Type = ID ['.' ID] ['[' Type {',' Type} [','] ']'] | '*' Type | '(' Type ')' | TypeLiteral
TypeLiteral = '[' [Expr | '...'] ']' Type | 'map' '[' Type ']' Type | 'chan' ['<-'] Type | '<-' 'chan' Type | 'func' Signature | Struct | Interface
Struct = 'struct' '{' [Field {';' Field} [';']] '}'
Field = (ID {',' ID} Type | ['*'] ID ['.' ID] ['[' Type {',' Type} ']']) [STR]
Interface = 'interface' '{' [Element {';' Element} [';']] '}'
Element = ID Signature | Constraint
Signature = '(' [Params] ')' ['(' [Params] ')' | Type]
Params = Param {',' Param} [',']
Param = [ID] ['...'] Type
Func = 'func' ['(' [Params] ')'] ID [TypeParams] Signature [Block]
Block = '{' Stmts '}'
Stmts = [Stmt] {';' [Stmt]}
Stmt = Simple | 'return' [Exprs] | If | For | Switch | Select | ('go' | 'defer') Expr | ('break' | 'continue') [ID] | 'goto' ID | 'fallthrough' | Block | Decl | ID ':' [Stmt]
Simple = Exprs [(Assign) Exprs | '++' | '--' | '<-' Expr]
Assign = '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
If = 'if' [[Simple] ';'] Expr Block ['else' (If | Block)]
For = 'for' [Simple | [Simple] ';' [Expr] ';' [Simple] | [Exprs ('=' | ':=')] 'range' Expr] Block
Switch = 'switch' [[Simple] ';'] [Simple] '{' {('case' Case {',' Case} | 'default') ':' Stmts} '}'
Case = Expr | Type
Select = 'select' '{' {('case' Simple | 'default') ':' Stmts} '}'
Exprs = Expr {',' Expr}
Expr = Operand {Op Operand}
Op = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^'
Operand = {'+' | '-' | '!' | '^' | '*' | '&' | '<-'} Primary {Postfix}
Primary = ID | NUM | STR | 'func' Signature Block | '(' (Expr | Type) ')' | TypeLiteral
Postfix = '.' (ID | '(' (Type | 'type') ')') | '[' (Index {',' Index} [','] | [Expr] ':' [Expr] [':' Expr]) ']' | '(' [Arg {',' Arg} [',']] ')' | Literal
Index = Expr | Type
Arg = (Expr | Type) ['...']
Literal = '{' [Item {',' Item} [',']] '}'
Item = (Expr | Literal) [':' (Expr | Literal)]
"""

YAML = """
Stream = [Document] {DOC_END | DOC_START [Node] {DOC_END} | Directives DOC_START [Node]}
Directives = DIRECTIVE {DIRECTIVE}
Document = Node {DOC_END}
Node = ALIAS | Properties [Content] | Content
Properties = ANCHOR [TAG] | TAG [ANCHOR]
Content = SCALAR | Sequence | Mapping | FlowSeq | FlowMap
Sequence = SEQ_START {ENTRY [Node]} BLOCK_END
Mapping = MAP_START {KEY [Node] [VALUE [Indentless]] | VALUE [Indentless]} BLOCK_END
Indentless = Node | [Properties] ENTRY [Node] {ENTRY [Node]}
FlowSeq = '[' [FlowItem {',' FlowItem} [',']] ']'
FlowItem = Node | KEY [Node] [VALUE [Node]] | VALUE [Node]
FlowMap = '{' [FlowPair {',' FlowPair} [',']] '}'
FlowPair = KEY [Node] [VALUE [Node]] | Node | VALUE [Node]
"""

#: Grammar, root rule and lexer of each language; other spellings of a language's name follow.
_LANGUAGES = {
    "json": (JSON, "Doc", lexers.json),
    "python": (PYTHON, "File", lexers.python),
    "javascript": (JAVASCRIPT, "Program", lexers.javascript),
    "typescript": (TYPESCRIPT, "Program", lexers.javascript),
    "java": (JAVA, "Unit", lexers.java),
    "csharp": (CSHARP, "Unit", lexers.csharp),
    "go": (GO, "File", lexers.go),
    "yaml": (YAML, "Stream", yaml.yaml),
}
NAMES = {"js": "javascript", "ts": "typescript", "py": "python", "golang": "go", "c#": "csharp", "cs": "csharp", "yml": "yaml"}


def language_of(name: str | None) -> str | None:
    """The grammar's name for a language however it is spelled; null when there is no grammar."""
    key = "".join((name or "").lower().split())
    key = NAMES.get(key, key)
    return key if key in _LANGUAGES else None


@lru_cache(maxsize=None)
def parser(language: str) -> Parser:
    grammar, root, _ = _LANGUAGES[language]
    return Parser(compile_grammar(grammar, root))


def tokens(language: str, text: str) -> Tokens:
    return _LANGUAGES[language][2](text)


LANGUAGES = tuple(_LANGUAGES)
