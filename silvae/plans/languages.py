"""A text of each language with braces, and of templates, with the outline of its tree.

An outline has the nodes of one child of the root in order, each as its depth and type, and what the
leaves say. In a text and its outlines ``%1$d`` stands for a number.
"""

#: By extension: the text, and the outlines of the children of its root.
SAMPLES: dict[str, tuple[str, list[str]]] = {
    "rs": (
        'use std::io as i;\n'
        '/// doc\n'
        'pub struct S%1$d { v: u8 }\n'
        'enum E { A(i32), B }\n'
        'trait T { fn q(&self); }\n'
        'impl<\'a> T for S<\'a> { fn q(&self) { println!("x"); } }\n'
        'pub fn f%1$d<T: Clone>(a: T, mut b: i32) -> Option<i32> {\n'
        '  let x = a.b(1)?.c::<u8>();\n'
        '  let s = r#"raw "q" // no "#;\n'
        "  let c = 'x'; /* note */\n"
        '  match x { Some(v) => g(v), _ => {} }\n'
        '  for i in 0..10 { b += i * 2 + 1; }\n'
        '  while b < 3 && b != 4 { b *= 2; }\n'
        '  if b == 1 { return None; } else if !c { loop { break; } } else { h(); }\n'
        '  vec![1, 2].iter().map(|z| z + 1);\n'
        '  let t = xs[0].y;\n'
        '  Self::new(&mut b, -1);\n'
        '  const N: usize = 3;\n'
        '  Some(b)\n'
        '}\n'
        'mod m { type X = u8; }\n',
        [
            '1use_declaration 2identifier=std 2identifier=io 2identifier=as 2identifier=i',
            '1comment=/// doc',
            '1struct_item 2modifier=pub 2type_identifier=S%1$d 2block 3identifier=v 3identifier=u8',
            '1enum_item 2type_identifier=E 2block 3call_expression 4identifier=A 4arguments 5identifier=i32 3identifier=B',
            '1trait_item 2type_identifier=T 2block 3function_item 4identifier=q 4parameters 5parameter 6identifier=self',
            '1impl_item 2type_parameters 3type_identifier=\'a 2type_identifier=T 2type_identifier=for 2type_identifier=S 2type_identifier=\'a 2block 3function_item 4identifier=q 4parameters 5parameter 6identifier=self 4block 5macro_invocation=println!("x")',
            '1function_item 2modifier=pub 2identifier=f%1$d 2type_parameters 3type_identifier=T 3type_identifier=Clone 2parameters 3parameter 4identifier=a 4type_identifier=T 3parameter 4identifier=b 4type_identifier=i32 2type_identifier=Option 2type_identifier=i32 2block 3let_binding 4assignment_expression 5identifier=x 5call_expression 6field_expression 7call_expression 8field_expression 9identifier=a 9field_identifier=b 8arguments 9number_literal=1 7field_identifier=c 3let_binding 4assignment_expression 5identifier=s 5string_literal=r#"raw "q" // no "# 3let_binding 4assignment_expression 5identifier=c 5string_literal=\'x\' 3comment=/* note */ 3match_expression 4identifier=x 4block 5match_arm 6call_expression 7identifier=Some 7arguments 8identifier=v 6call_expression 7identifier=g 7arguments 8identifier=v 5match_arm 6identifier=_ 6block={} 3for_statement 4binary_expression 5identifier=i 5binary_expression 6number_literal=0 6number_literal=10 4block 5assignment_expression 6identifier=b 6binary_expression 7binary_expression 8identifier=i 8number_literal=2 7number_literal=1 3while_statement 4binary_expression 5binary_expression 6identifier=b 6number_literal=3 5binary_expression 6identifier=b 6number_literal=4 4block 5assignment_expression 6identifier=b 6number_literal=2 3if_statement 4binary_expression 5identifier=b 5number_literal=1 4block 5return_statement 6identifier=None 4else_clause 5if_statement 6unary_expression 7identifier=c 6block 7loop_expression 8block 9break_statement=break; 6else_clause 7block 8call_expression 9identifier=h 3call_expression 4field_expression 5call_expression 6field_expression 7macro_invocation=vec![1, 2] 7field_identifier=iter 5field_identifier=map 4arguments 5closure_expression 6identifier=z 6binary_expression 7identifier=z 7number_literal=1 3let_binding 4assignment_expression 5identifier=t 5field_expression 6index_expression 7identifier=xs 7number_literal=0 6field_identifier=y 3call_expression 4field_expression 5identifier=Self 5field_identifier=new 4arguments 5unary_expression 6unary_expression 7identifier=b 5unary_expression 6number_literal=1 3const_item 4identifier=N 4assignment_expression 5identifier=usize 5number_literal=3 3call_expression 4identifier=Some 4arguments 5identifier=b',
            '1mod_item 2identifier=m 2block 3type_item 4type_identifier=X 4identifier=u8',
        ],
    ),
    "js": (
        '// head\n'
        "import a, { b } from './m.js';\n"
        "const x = 1, y = 'two';\n"
        'let z = `t ${x} // no`;\n'
        'function f%1$d(p, q = 2) { return p + q * 3; }\n'
        'async function g() { await f(1); }\n'
        'class K%1$d extends B {\n'
        '  m(a) { this.v = a; }\n'
        '  static s() { return null; }\n'
        '}\n'
        'if (x > 1 && y) { f(x); } else if (z) { g(); } else { h(); }\n'
        'for (let i = 0; i < 3; i++) { f(i); }\n'
        'while (true) { break; }\n'
        'try { f(); } catch (e) { g(e); } finally { h(); }\n'
        'switch (x) { case 1: f(); break; default: g(); }\n'
        'const arrow = (a, b) => a.c(b);\n'
        'const o = { k: 1, l: [1, 2] };\n'
        'new K(o.k);\n'
        'x = y ? f(1) : !z\n'
        'w[0].v += 1\n'
        '/* block\n'
        '   comment */\n'
        'export default f;\n',
        [
            '1comment=// head',
            "1import_declaration 2identifier=a 2identifier=b 2identifier=from 2string_literal='./m.js'",
            "1const_declaration 2assignment_expression 3identifier=x 3number_literal=1 2assignment_expression 3identifier=y 3string_literal='two'",
            '1let_declaration 2assignment_expression 3identifier=z 3string_literal=`t ${x} // no`',
            '1function_declaration 2identifier=f%1$d 2parameters 3identifier=p 3assignment_expression 4identifier=q 4number_literal=2 2block 3return_statement 4binary_expression 5identifier=p 5binary_expression 6identifier=q 6number_literal=3',
            '1function_declaration 2modifier=async 2identifier=g 2block 3await_expression 4call_expression 5identifier=f 5arguments 6number_literal=1',
            '1class_declaration 2type_identifier=K%1$d 2type_identifier=extends 2type_identifier=B 2block 3method_declaration 4identifier=m 4parameters 5identifier=a 4block 5assignment_expression 6field_expression 7identifier=this 7field_identifier=v 6identifier=a 3method_declaration 4modifier=static 4identifier=s 4block 5return_statement 6null_literal=null',
            '1if_statement 2parenthesized_expression 3binary_expression 4binary_expression 5identifier=x 5number_literal=1 4identifier=y 2block 3call_expression 4identifier=f 4arguments 5identifier=x 2else_clause 3if_statement 4parenthesized_expression 5identifier=z 4block 5call_expression 6identifier=g 4else_clause 5block 6call_expression 7identifier=h',
            '1for_statement 2header 3let_declaration 4assignment_expression 5identifier=i 5number_literal=0 3binary_expression 4identifier=i 4number_literal=3 3postfix_expression 4identifier=i 2block 3call_expression 4identifier=f 4arguments 5identifier=i',
            '1while_statement 2parenthesized_expression 3boolean_literal=true 2block 3break_statement=break;',
            '1try_statement 2block 3call_expression 4identifier=f 2catch_clause 3header 4identifier=e 3block 4call_expression 5identifier=g 5arguments 6identifier=e 2finally_clause 3block 4call_expression 5identifier=h',
            '1switch_statement 2parenthesized_expression 3identifier=x 2block 3switch_case 4number_literal=1 4call_expression 5identifier=f 4break_statement=break; 3switch_default 4call_expression 5identifier=g',
            '1const_declaration 2assignment_expression 3identifier=arrow 3lambda_expression 4parenthesized_expression 5identifier=a 5identifier=b 4call_expression 5field_expression 6identifier=a 6field_identifier=c 5arguments 6identifier=b',
            '1const_declaration 2assignment_expression 3identifier=o 3block 4identifier=k 4number_literal=1 4identifier=l 4array_expression 5number_literal=1 5number_literal=2',
            '1new_expression 2call_expression 3identifier=K 3arguments 4field_expression 5identifier=o 5field_identifier=k',
            '1assignment_expression 2identifier=x 2conditional_expression 3identifier=y 3call_expression 4identifier=f 4arguments 5number_literal=1 3unary_expression 4identifier=z',
            '1assignment_expression 2field_expression 3index_expression 4identifier=w 4number_literal=0 3field_identifier=v 2number_literal=1',
            '1comment=/* block\n   comment */',
            '1identifier=f',
        ],
    ),
    "ts": (
        'import { a } from "m";\n'
        'interface I%1$d { x: number; m(s: string): void; }\n'
        'enum E { A, B }\n'
        'type U = string | number;\n'
        'namespace N { const v = 1; }\n'
        'abstract class C%1$d<T> extends D implements I {\n'
        '  private readonly x: number = 1;\n'
        '  constructor(private a: string) { super(a); }\n'
        '  public get v(): T { return this.x as T; }\n'
        '  async m<R>(r: R[]): Promise<R> { return await this.n(r); }\n'
        '}\n'
        'function f(a: number, b?: string): void { g<string>(a, b!); }\n'
        'const h = async (x: number) => x ** 2;\n'
        'let t: Map<string, number> = new Map();\n'
        'for (const k of t.keys()) { f(k); }\n'
        'do { f(1); } while (x < 2)\n'
        'if (a) return;\n'
        "throw new Error('e');\n"
        'x ??= y?.z;\n'
        '// end\n',
        [
            '1import_declaration 2identifier=a 2identifier=from 2string_literal="m"',
            '1interface_declaration 2type_identifier=I%1$d 2block 3identifier=x 3identifier=number 3call_expression 4identifier=m 4arguments 5identifier=s 5identifier=string 3identifier=void',
            '1enum_declaration 2type_identifier=E 2block 3identifier=A 3identifier=B',
            '1type_declaration 2type_identifier=U 2binary_expression 3identifier=string 3identifier=number',
            '1namespace_definition 2identifier=N 2block 3const_declaration 4assignment_expression 5identifier=v 5number_literal=1',
            '1class_declaration 2modifier=abstract 2type_identifier=C%1$d 2type_parameters 3type_identifier=T 2type_identifier=extends 2type_identifier=D 2type_identifier=implements 2type_identifier=I 2block 3identifier=x 3assignment_expression 4identifier=number 4number_literal=1 3method_declaration 4identifier=constructor 4parameters 5identifier=a 5identifier=string 4block 5call_expression 6identifier=super 6arguments 7identifier=a 3method_declaration 4modifier=public 4modifier=get 4identifier=v 4type_identifier=T 4block 5return_statement 6binary_expression 7field_expression 8identifier=this 8field_identifier=x 7identifier=T 3method_declaration 4modifier=async 4identifier=m 4parameters 5identifier=r 5index_expression 6identifier=R 4type_identifier=Promise 4type_identifier=R 4block 5return_statement 6await_expression 7call_expression 8field_expression 9identifier=this 9field_identifier=n 8arguments 9identifier=r',
            '1function_declaration 2identifier=f 2parameters 3identifier=a 3identifier=number 3identifier=b 3identifier=string 2type_identifier=void 2block 3call_expression 4identifier=g 4arguments 5identifier=a 5postfix_expression 6identifier=b',
            '1const_declaration 2assignment_expression 3identifier=h 3lambda_expression 4call_expression 5identifier=async 5arguments 6identifier=x 6identifier=number 4binary_expression 5identifier=x 5number_literal=2',
            '1let_declaration 2identifier=t 2assignment_expression 3generic_type 4identifier=Map 4type_identifier=string 4type_identifier=number 3new_expression 4call_expression 5identifier=Map',
            '1for_statement 2header 3const_declaration 4identifier=k 4identifier=of 4call_expression 5field_expression 6identifier=t 6field_identifier=keys 2block 3call_expression 4identifier=f 4arguments 5identifier=k',
            '1do_statement 2block 3call_expression 4identifier=f 4arguments 5number_literal=1 2parenthesized_expression 3binary_expression 4identifier=x 4number_literal=2',
            '1if_statement 2parenthesized_expression 3identifier=a 2return_statement=return;',
            "1throw_statement 2new_expression 3call_expression 4identifier=Error 4arguments 5string_literal='e'",
            '1assignment_expression 2identifier=x 2field_expression 3identifier=y 3field_identifier=z',
            '1comment=// end',
        ],
    ),
    "php": (
        '<?php\n'
        'namespace A;\n'
        'use B\\C;\n'
        '# note\n'
        'function f%1$d($a, $b = 2) { return $a . $b; }\n'
        'class K%1$d extends P implements I {\n'
        '  const X = 1;\n'
        "  public $v = 'q // no';\n"
        '  public static function m(array $xs) { foreach ($xs as $x) { self::g($x); } }\n'
        '  private function n() { $this->v = new K(1); return $this->m([1, 2]); }\n'
        '}\n'
        'interface I { }\n'
        'trait T { }\n'
        'if ($a == 1) { echo "x"; } else { f($a); }\n'
        'for ($i = 0; $i < 3; $i++) { f($i); }\n'
        'while ($a) { break; }\n'
        'do { f(1); } while ($a);\n'
        'switch ($a) { case 1: f(); break; default: g(); }\n'
        'try { f(); } catch (E $e) { throw $e; }\n'
        '$z = $a ? 1 : null;\n'
        '/* end */\n',
        [
            '1comment=<?php',
            '1namespace_definition 2identifier=A',
            '1use_declaration 2identifier=B 2identifier=C',
            '1comment=# note',
            '1function_declaration 2identifier=f%1$d 2parameters 3parameter 4identifier=$a 3parameter 4identifier=$b 4number_literal=2 2block 3return_statement 4binary_expression 5identifier=$a 5identifier=$b',
            "1class_declaration 2type_identifier=K%1$d 2type_identifier=extends 2type_identifier=P 2type_identifier=implements 2type_identifier=I 2block 3const_declaration 4assignment_expression 5identifier=X 5number_literal=1 3assignment_expression 4identifier=$v 4string_literal='q // no' 3function_declaration 4modifier=public 4modifier=static 4identifier=m 4parameters 5parameter 6identifier=array 6type_identifier=$xs 4block 5foreach_statement 6header 7binary_expression 8identifier=$xs 8identifier=$x 6block 7call_expression 8field_expression 9identifier=self 9field_identifier=g 8arguments 9identifier=$x 3function_declaration 4modifier=private 4identifier=n 4block 5assignment_expression 6field_expression 7identifier=$this 7field_identifier=v 6new_expression 7call_expression 8identifier=K 8arguments 9number_literal=1 5return_statement 6call_expression 7field_expression 8identifier=$this 8field_identifier=m 7arguments 8array_expression 9number_literal=1 9number_literal=2",
            '1interface_declaration 2type_identifier=I 2block={ }',
            '1trait_declaration 2type_identifier=T 2block={ }',
            '1if_statement 2parenthesized_expression 3binary_expression 4identifier=$a 4number_literal=1 2block 3echo_statement 4string_literal="x" 2else_clause 3block 4call_expression 5identifier=f 5arguments 6identifier=$a',
            '1for_statement 2header 3assignment_expression 4identifier=$i 4number_literal=0 3binary_expression 4identifier=$i 4number_literal=3 3postfix_expression 4identifier=$i 2block 3call_expression 4identifier=f 4arguments 5identifier=$i',
            '1while_statement 2parenthesized_expression 3identifier=$a 2block 3break_statement=break;',
            '1do_statement 2block 3call_expression 4identifier=f 4arguments 5number_literal=1 2parenthesized_expression 3identifier=$a',
            '1switch_statement 2parenthesized_expression 3identifier=$a 2block 3case_statement 4number_literal=1 4call_expression 5identifier=f 4break_statement=break; 3default_statement 4call_expression 5identifier=g',
            '1try_statement 2block 3call_expression 4identifier=f 2catch_clause 3header 4identifier=E 4identifier=$e 3block 4throw_statement 5identifier=$e',
            '1assignment_expression 2identifier=$z 2conditional_expression 3identifier=$a 3number_literal=1 3null_literal=null',
            '1comment=/* end */',
        ],
    ),
    "go": (
        'package main\n'
        'import "fmt"\n'
        'type T%1$d struct { a int }\n'
        'const N = 3\n'
        'var q = "s"\n'
        '// note\n'
        'func (t *T) M%1$d(x int, y string) int {\n'
        '\tif x > 0 { return t.a + x }\n'
        '\tfor i := 0; i < N; i++ { fmt.Println(i, "s // no") }\n'
        '\tswitch x { case 1: t.M(2) }\n'
        '\tgo f(1)\n'
        '\tdefer g()\n'
        '\tv := []int{1, 2}\n'
        '\tv[0] = x * 2 + 1\n'
        '\th(func(a int) int { return a })\n'
        '\tif !ok { panic("x") } else { return 0 }\n'
        '\tselect { case c: f(2) }\n'
        '\tp := &x\n'
        '\treturn *p\n'
        '}\n'
        'func f(a int) { }\n'
        '/* end */\n',
        [
            '1package_clause 2identifier=main',
            '1import_declaration 2string_literal="fmt"',
            '1type_declaration 2type_identifier=T%1$d 2type_identifier=struct 2block 3identifier=a 3identifier=int',
            '1const_declaration 2assignment_expression 3identifier=N 3number_literal=3',
            '1variable_declaration 2assignment_expression 3identifier=q 3string_literal="s"',
            '1comment=// note',
            '1function_declaration 2parameters 3parameter 4identifier=t 4type_identifier=T 2identifier=M%1$d 2parameters 3parameter 4identifier=x 4type_identifier=int 3parameter 4identifier=y 4type_identifier=string 2type_identifier=int 2block 3if_statement 4binary_expression 5identifier=x 5number_literal=0 4block 5return_statement 6binary_expression 7field_expression 8identifier=t 8field_identifier=a 7identifier=x 3for_statement 4assignment_expression 5identifier=i 5number_literal=0 4binary_expression 5identifier=i 5identifier=N 4postfix_expression 5identifier=i 4block 5call_expression 6field_expression 7identifier=fmt 7field_identifier=Println 6arguments 7identifier=i 7string_literal="s // no" 3switch_statement 4identifier=x 4block 5case_clause 6number_literal=1 6call_expression 7field_expression 8identifier=t 8field_identifier=M 7arguments 8number_literal=2 3go_statement 4call_expression 5identifier=f 5arguments 6number_literal=1 3defer_statement 4call_expression 5identifier=g 3assignment_expression 4identifier=v 4composite_literal 5type_identifier=int 5block 6number_literal=1 6number_literal=2 3assignment_expression 4index_expression 5identifier=v 5number_literal=0 4binary_expression 5binary_expression 6identifier=x 6number_literal=2 5number_literal=1 3call_expression 4identifier=h 4arguments 5function_declaration 6parameters 7parameter 8identifier=a 8type_identifier=int 6type_identifier=int 6block 7return_statement 8identifier=a 3if_statement 4unary_expression 5identifier=ok 4block 5call_expression 6identifier=panic 6arguments 7string_literal="x" 4else_clause 5block 6return_statement 7number_literal=0 3select_statement 4block 5case_clause 6identifier=c 6call_expression 7identifier=f 7arguments 8number_literal=2 3assignment_expression 4identifier=p 4unary_expression 5identifier=x 3return_statement 4unary_expression 5identifier=p',
            '1function_declaration 2identifier=f 2parameters 3parameter 4identifier=a 4type_identifier=int 2block={ }',
            '1comment=/* end */',
        ],
    ),
    "c": (
        '#include <stdio.h>\n'
        '/* block */\n'
        'struct P%1$d { int x; int y; };\n'
        'enum E { A, B };\n'
        'static int add%1$d(int a, int *b) { return a + *b; }\n'
        'int main(void) {\n'
        '  int v = add(1, &w);\n'
        '  char *s = "hi // no";\n'
        '  if (v == 2) { puts(s); } else puts("no");\n'
        '  for (int i = 0; i < v; i++) { v += i; }\n'
        '  while (v) v--;\n'
        '  do { v--; } while (v > 0);\n'
        '  switch (v) { case 1: break; default: v = 2; }\n'
        '  p->x = q.y[3];\n'
        '  goto end;\n'
        "  char c = 'x';\n"
        '  v = a << 2 | b & 1;\n'
        '  continue;\n'
        '  return v ? 1 : 0;\n'
        '}\n'
        '// end\n',
        [
            '1comment=#include <stdio.h>',
            '1comment=/* block */',
            '1struct_item 2type_identifier=P%1$d 2block 3variable_declaration 4type_identifier=int 4identifier=x 3variable_declaration 4type_identifier=int 4identifier=y',
            '1enum_declaration 2type_identifier=E 2block 3identifier=A 3identifier=B',
            '1function_declaration 2modifier=static 2identifier=add%1$d 2type_identifier=int 2parameters 3parameter 4type_identifier=int 4identifier=a 3parameter 4type_identifier=int 4identifier=b 2block 3return_statement 4binary_expression 5identifier=a 5unary_expression 6identifier=b',
            '1function_declaration 2identifier=main 2type_identifier=int 2parameters 3identifier=void 2block 3variable_declaration 4type_identifier=int 4assignment_expression 5identifier=v 5call_expression 6identifier=add 6arguments 7number_literal=1 7unary_expression 8identifier=w 3variable_declaration 4type_identifier=char 4assignment_expression 5identifier=s 5string_literal="hi // no" 3if_statement 4parenthesized_expression 5binary_expression 6identifier=v 6number_literal=2 4block 5call_expression 6identifier=puts 6arguments 7identifier=s 4else_clause 5call_expression 6identifier=puts 6arguments 7string_literal="no" 3for_statement 4header 5variable_declaration 6type_identifier=int 6assignment_expression 7identifier=i 7number_literal=0 5binary_expression 6identifier=i 6identifier=v 5postfix_expression 6identifier=i 4block 5assignment_expression 6identifier=v 6identifier=i 3while_statement 4parenthesized_expression 5identifier=v 4postfix_expression 5identifier=v 3do_statement 4block 5postfix_expression 6identifier=v 4parenthesized_expression 5binary_expression 6identifier=v 6number_literal=0 3switch_statement 4parenthesized_expression 5identifier=v 4block 5case_statement 6number_literal=1 6break_statement=break; 5default_statement 6assignment_expression 7identifier=v 7number_literal=2 3assignment_expression 4field_expression 5identifier=p 5field_identifier=x 4index_expression 5field_expression 6identifier=q 6field_identifier=y 5number_literal=3 3goto_statement 4identifier=end 3variable_declaration 4type_identifier=char 4assignment_expression 5identifier=c 5string_literal=\'x\' 3assignment_expression 4identifier=v 4binary_expression 5binary_expression 6identifier=a 6number_literal=2 5binary_expression 6identifier=b 6number_literal=1 3continue_statement=continue; 3return_statement 4conditional_expression 5identifier=v 5number_literal=1 5number_literal=0',
            '1comment=// end',
        ],
    ),
    "cpp": (
        '#include <a>\n'
        'using namespace std;\n'
        'namespace n%1$d {\n'
        'class C : public B {\n'
        'public:\n'
        '  C(int a) : x(a) { }\n'
        '  virtual int m(const T<int> v) const { return this->x + v; }\n'
        'private:\n'
        '  int x;\n'
        '};\n'
        'template <typename T> T f%1$d(T a) { return a; }\n'
        '}\n'
        'enum class E { A };\n'
        'int main() {\n'
        '  auto v = new C(1);\n'
        '  std::vector<int> w;\n'
        '  for (auto i : w) { v->m(i); }\n'
        '  try { throw 1; } catch (int e) { f(e); }\n'
        '  if (!v) return 1;\n'
        '  auto l = R"(raw " ))";\n'
        '  delete v;\n'
        '  w[0]++;\n'
        '}\n'
        '// end\n',
        [
            '1comment=#include <a>',
            '1using_declaration 2identifier=namespace 2identifier=std',
            '1namespace_definition 2identifier=n%1$d 2block 3class_declaration 4type_identifier=C 4type_identifier=public 4type_identifier=B 4block 5access_specifier=public 5method_declaration 6identifier=C 6parameters 7parameter 8type_identifier=int 8identifier=a 6type_identifier=x 6type_identifier=a 6block={ } 5method_declaration 6modifier=virtual 6identifier=m 6type_identifier=int 6parameters 7parameter 8type_identifier=T 8type_identifier=int 8identifier=v 6type_identifier=const 6block 7return_statement 8binary_expression 9field_expression 10identifier=this 10field_identifier=x 9identifier=v 5access_specifier=private 5variable_declaration 6type_identifier=int 6identifier=x 3template_declaration 4type_parameters 5type_identifier=typename 5type_identifier=T 4type_identifier=T 4type_identifier=f%1$d 4parameters 5parameter 6type_identifier=T 6identifier=a 4block 5return_statement 6identifier=a',
            '1enum_declaration 2type_identifier=E 2block 3identifier=A',
            '1function_declaration 2identifier=main 2type_identifier=int 2block 3variable_declaration 4type_identifier=auto 4assignment_expression 5identifier=v 5new_expression 6call_expression 7identifier=C 7arguments 8number_literal=1 3variable_declaration 4type_identifier=std 4type_identifier=vector 4type_identifier=int 4identifier=w 3for_statement 4header 5variable_declaration 6type_identifier=auto 6identifier=i 6identifier=w 4block 5call_expression 6field_expression 7identifier=v 7field_identifier=m 6arguments 7identifier=i 3try_statement 4block 5throw_statement 6number_literal=1 4catch_clause 5header 6variable_declaration 7type_identifier=int 7identifier=e 5block 6call_expression 7identifier=f 7arguments 8identifier=e 3if_statement 4parenthesized_expression 5unary_expression 6identifier=v 4return_statement 5number_literal=1 3variable_declaration 4type_identifier=auto 4assignment_expression 5identifier=l 5string_literal=R"(raw " ))" 3unary_expression 4identifier=v 3postfix_expression 4index_expression 5identifier=w 5number_literal=0',
            '1comment=// end',
        ],
    ),
    "java": (
        'package a.b;\n'
        'import java.util.List;\n'
        '// note\n'
        '@Test\n'
        'public class C%1$d<T> extends D implements E {\n'
        '  private final List<String> xs = new ArrayList<>();\n'
        '  public C%1$d(int a) { this.a = a; }\n'
        '  @Override\n'
        '  public static int m(String s, int[] k) throws X {\n'
        '    for (String t : xs) { use(t); }\n'
        '    if (s == null) return 1;\n'
        '    try { xs.add("q // no"); } catch (X e) { throw e; } finally { done(); }\n'
        '    Runnable r = () -> m(s, k);\n'
        '    while (k[0] > 1) { k[0]--; }\n'
        '    do { m(s); } while (true);\n'
        '    switch (k[1]) { case 1: m(s); break; default: continue; }\n'
        '    String t = s != null ? "a" : \'b\';\n'
        '    int v = 1 + 2 * 3;\n'
        '    return v;\n'
        '  }\n'
        '  enum Z { A, B }\n'
        '  interface I { void q(); }\n'
        '}\n',
        [
            '1package_declaration 2identifier=a 2identifier=b',
            '1import_declaration 2identifier=java 2identifier=util 2identifier=List',
            '1comment=// note',
            '1annotation 2identifier=Test',
            '1class_declaration 2modifier=public 2type_identifier=C%1$d 2type_parameters 3type_identifier=T 2type_identifier=extends 2type_identifier=D 2type_identifier=implements 2type_identifier=E 2block 3variable_declaration 4type_identifier=List 4type_identifier=String 4assignment_expression 5identifier=xs 5new_expression 6call_expression 7identifier=ArrayList 3method_declaration 4modifier=public 4identifier=C%1$d 4parameters 5parameter 6type_identifier=int 6identifier=a 4block 5assignment_expression 6field_expression 7identifier=this 7field_identifier=a 6identifier=a 3annotation 4identifier=Override 3method_declaration 4modifier=public 4modifier=static 4identifier=m 4type_identifier=int 4parameters 5parameter 6type_identifier=String 6identifier=s 5parameter 6type_identifier=int 6identifier=k 4type_identifier=throws 4type_identifier=X 4block 5for_statement 6header 7variable_declaration 8type_identifier=String 8identifier=t 8identifier=xs 6block 7call_expression 8identifier=use 8arguments 9identifier=t 5if_statement 6parenthesized_expression 7binary_expression 8identifier=s 8null_literal=null 6return_statement 7number_literal=1 5try_statement 6block 7call_expression 8field_expression 9identifier=xs 9field_identifier=add 8arguments 9string_literal="q // no" 6catch_clause 7header 8variable_declaration 9type_identifier=X 9identifier=e 7block 8throw_statement 9identifier=e 6finally_clause 7block 8call_expression 9identifier=done 5variable_declaration 6type_identifier=Runnable 6assignment_expression 7identifier=r 7lambda_expression 8parenthesized_expression=() 8call_expression 9identifier=m 9arguments 10identifier=s 10identifier=k 5while_statement 6parenthesized_expression 7binary_expression 8index_expression 9identifier=k 9number_literal=0 8number_literal=1 6block 7postfix_expression 8index_expression 9identifier=k 9number_literal=0 5do_statement 6block 7call_expression 8identifier=m 8arguments 9identifier=s 6parenthesized_expression 7boolean_literal=true 5switch_statement 6parenthesized_expression 7index_expression 8identifier=k 8number_literal=1 6block 7switch_label 8number_literal=1 8call_expression 9identifier=m 9arguments 10identifier=s 8break_statement=break; 7switch_label 8continue_statement=continue; 5variable_declaration 6type_identifier=String 6assignment_expression 7identifier=t 7conditional_expression 8binary_expression 9identifier=s 9null_literal=null 8string_literal="a" 8string_literal=\'b\' 5variable_declaration 6type_identifier=int 6assignment_expression 7identifier=v 7binary_expression 8number_literal=1 8binary_expression 9number_literal=2 9number_literal=3 5return_statement 6identifier=v 3enum_declaration 4type_identifier=Z 4block 5identifier=A 5identifier=B 3interface_declaration 4type_identifier=I 4block 5method_declaration 6identifier=q 6type_identifier=void',
        ],
    ),
    "zig": (
        'const std = @import("std");\n'
        '// note\n'
        'pub fn f%1$d(a: i32, b: u8) void {\n'
        '    var x: i32 = a + 1 * 2;\n'
        '    if (x > 1) { g(x); } else { h(); }\n'
        '    while (x < 3) { x += 1; }\n'
        '    for (xs) |y| { g(y); }\n'
        '    defer g(2);\n'
        '    const s = "a // no";\n'
        '    std.debug.print(s, b);\n'
        '    switch (x) { 1 => g(1) }\n'
        '    try k(x);\n'
        '    return;\n'
        '}\n'
        'test "t%1$d" { f(1, 2); }\n',
        [
            '1const_declaration 2assignment_expression 3identifier=std 3annotation 4call_expression 5identifier=import 5arguments 6string_literal="std"',
            '1comment=// note',
            '1function_declaration 2modifier=pub 2identifier=f%1$d 2parameters 3parameter 4identifier=a 4type_identifier=i32 3parameter 4identifier=b 4type_identifier=u8 2type_identifier=void 2block 3variable_declaration 4identifier=x 4assignment_expression 5identifier=i32 5binary_expression 6identifier=a 6binary_expression 7number_literal=1 7number_literal=2 3if_statement 4parenthesized_expression 5binary_expression 6identifier=x 6number_literal=1 4block 5call_expression 6identifier=g 6arguments 7identifier=x 4else_clause 5block 6call_expression 7identifier=h 3while_statement 4parenthesized_expression 5binary_expression 6identifier=x 6number_literal=3 4block 5assignment_expression 6identifier=x 6number_literal=1 3for_statement 4header 5identifier=xs 4payload 5identifier=y 4block 5call_expression 6identifier=g 6arguments 7identifier=y 3defer_statement 4call_expression 5identifier=g 5arguments 6number_literal=2 3const_declaration 4assignment_expression 5identifier=s 5string_literal="a // no" 3call_expression 4field_expression 5field_expression 6identifier=std 6field_identifier=debug 5field_identifier=print 4arguments 5identifier=s 5identifier=b 3switch_statement 4parenthesized_expression 5identifier=x 4block 5match_arm 6number_literal=1 6call_expression 7identifier=g 7arguments 8number_literal=1 3unary_expression 4call_expression 5identifier=k 5arguments 6identifier=x 3return_statement=return;',
            '1test_declaration 2string_literal="t%1$d" 2block 3call_expression 4identifier=f 4arguments 5number_literal=1 5number_literal=2',
        ],
    ),
    "kt": (
        'package a.b\n'
        'import c.D\n'
        '// note\n'
        'data class P%1$d(val x: Int, var y: String = "q")\n'
        'interface I { fun q(a: Int): Int }\n'
        'object O { val z = 1 }\n'
        'fun <T> f%1$d(a: List<T>, b: Int): Int {\n'
        '    val v = a.size + b * 2\n'
        '    var s = """raw " // no"""\n'
        '    if (v > 1) { g(v) } else { h() }\n'
        '    for (i in 0..3) { g(i) }\n'
        '    while (true) { break }\n'
        '    when (v) { 1 -> g(1) }\n'
        '    a.map { g(2) }\n'
        '    run(1) { g(3) }\n'
        '    try { g(4) } catch (e: E) { throw e }\n'
        '    v ?: null\n'
        '    x = !y\n'
        '    return v\n'
        '}\n'
        'fun e(n: Int) = n + 1\n'
        '/* end */\n',
        [
            '1package_header 2identifier=a 2identifier=b',
            '1import_declaration 2identifier=c 2identifier=D',
            '1comment=// note',
            '1class_declaration 2modifier=data 2type_identifier=P%1$d 2parameters 3parameter 4modifier=val 4identifier=x 4type_identifier=Int 3parameter 4modifier=var 4identifier=y 4type_identifier=String 4string_literal="q"',
            '1interface_declaration 2type_identifier=I 2block 3function_declaration 4identifier=q 4parameters 5parameter 6identifier=a 6type_identifier=Int 4type_identifier=Int',
            '1object_declaration 2type_identifier=O 2block 3variable_declaration 4assignment_expression 5identifier=z 5number_literal=1',
            '1function_declaration 2type_parameters 3type_identifier=T 2identifier=f%1$d 2parameters 3parameter 4identifier=a 4type_identifier=List 4type_parameters 5type_identifier=T 3parameter 4identifier=b 4type_identifier=Int 2type_identifier=Int 2block 3variable_declaration 4assignment_expression 5identifier=v 5binary_expression 6field_expression 7identifier=a 7field_identifier=size 6binary_expression 7identifier=b 7number_literal=2 3variable_declaration 4assignment_expression 5identifier=s 5string_literal="""raw " // no""" 3if_statement 4parenthesized_expression 5binary_expression 6identifier=v 6number_literal=1 4block 5call_expression 6identifier=g 6arguments 7identifier=v 4else_clause 5block 6call_expression 7identifier=h 3for_statement 4header 5binary_expression 6identifier=i 6binary_expression 7number_literal=0 7number_literal=3 4block 5call_expression 6identifier=g 6arguments 7identifier=i 3while_statement 4parenthesized_expression 5boolean_literal=true 4block 5break_statement=break 3when_expression 4parenthesized_expression 5identifier=v 4block 5match_arm 6number_literal=1 6call_expression 7identifier=g 7arguments 8number_literal=1 3call_expression 4field_expression 5identifier=a 5field_identifier=map 4block 5call_expression 6identifier=g 6arguments 7number_literal=2 3call_expression 4identifier=run 4arguments 5number_literal=1 4block 5call_expression 6identifier=g 6arguments 7number_literal=3 3try_statement 4block 5call_expression 6identifier=g 6arguments 7number_literal=4 4catch_clause 5header 6identifier=e 6identifier=E 5block 6throw_statement 7identifier=e 3binary_expression 4identifier=v 4null_literal=null 3assignment_expression 4identifier=x 4unary_expression 5identifier=y 3return_statement 4identifier=v',
            '1function_declaration 2identifier=e 2parameters 3parameter 4identifier=n 4type_identifier=Int 2binary_expression 3identifier=n 3number_literal=1',
            '1comment=/* end */',
        ],
    ),
    "swift": (
        'import Foundation\n'
        '// note\n'
        'class C%1$d: B {\n'
        '    let a = 1\n'
        '    var b: Int = 2\n'
        '    init(a: Int) { self.a = a }\n'
        '    override func m(x: Int, y: String) -> Int { return x + self.b * 2 }\n'
        '}\n'
        'struct S { }\n'
        'enum E { case one }\n'
        'protocol P { func q() }\n'
        'extension S { }\n'
        'func f%1$d(a: Int) -> Int {\n'
        '    guard a > 1 else { return 0 }\n'
        '    if a == 2 { g(a) } else { h("s // no") }\n'
        '    for i in 0..<3 { g(i) }\n'
        '    while true { break }\n'
        '    switch a { case 1: g(1) default: h() }\n'
        '    let v = a > 1 ? [1, 2] : nil\n'
        '    items.map { g(2) }\n'
        '    try g(3)\n'
        '    return v[0]\n'
        '}\n',
        [
            '1import_declaration 2identifier=Foundation',
            '1comment=// note',
            '1class_declaration 2type_identifier=C%1$d 2type_identifier=B 2block 3let_declaration 4assignment_expression 5identifier=a 5number_literal=1 3variable_declaration 4identifier=b 4assignment_expression 5identifier=Int 5number_literal=2 3init_declaration 4parenthesized_expression 5identifier=a 5identifier=Int 4block 5assignment_expression 6field_expression 7identifier=self 7field_identifier=a 6identifier=a 3function_declaration 4modifier=override 4identifier=m 4parameters 5parameter 6identifier=x 6type_identifier=Int 5parameter 6identifier=y 6type_identifier=String 4type_identifier=Int 4block 5return_statement 6binary_expression 7identifier=x 7binary_expression 8field_expression 9identifier=self 9field_identifier=b 8number_literal=2',
            '1struct_item 2type_identifier=S 2block={ }',
            '1enum_declaration 2type_identifier=E 2block 3case_clause 4identifier=one',
            '1protocol_declaration 2type_identifier=P 2block 3function_declaration 4identifier=q',
            '1extension_declaration 2type_identifier=S 2block={ }',
            '1function_declaration 2identifier=f%1$d 2parameters 3parameter 4identifier=a 4type_identifier=Int 2type_identifier=Int 2block 3guard_statement 4binary_expression 5identifier=a 5number_literal=1 4block 5return_statement 6number_literal=0 3if_statement 4binary_expression 5identifier=a 5number_literal=2 4block 5call_expression 6identifier=g 6arguments 7identifier=a 4else_clause 5block 6call_expression 7identifier=h 7arguments 8string_literal="s // no" 3for_statement 4binary_expression 5identifier=i 5binary_expression 6number_literal=0 6number_literal=3 4block 5call_expression 6identifier=g 6arguments 7identifier=i 3while_statement 4boolean_literal=true 4block 5break_statement=break 3switch_statement 4identifier=a 4block 5case_clause 6number_literal=1 6call_expression 7identifier=g 7arguments 8number_literal=1 5default_clause 6call_expression 7identifier=h 3let_declaration 4assignment_expression 5identifier=v 5conditional_expression 6binary_expression 7identifier=a 7number_literal=1 6array_expression 7number_literal=1 7number_literal=2 6null_literal=nil 3call_expression 4field_expression 5identifier=items 5field_identifier=map 4block 5call_expression 6identifier=g 6arguments 7number_literal=2 3unary_expression 4call_expression 5identifier=g 5arguments 6number_literal=3 3return_statement 4index_expression 5identifier=v 5number_literal=0',
        ],
    ),
    "cs": (
        'using System;\n'
        'namespace N%1$d {\n'
        '  // note\n'
        '  public class C%1$d : B {\n'
        '    private readonly int x = 1;\n'
        '    public C%1$d(int a) { this.x = a; }\n'
        '    public static async Task<int> M(string s, List<int> xs) {\n'
        '      foreach (var i in xs) { Use(i); }\n'
        '      if (s == null) return 1;\n'
        '      try { await F(s); } catch (E e) { throw e; } finally { Done(); }\n'
        '      var v = @"raw "" // no";\n'
        '      for (int i = 0; i < 3; i++) { Use(i); }\n'
        '      while (true) { break; }\n'
        '      switch (s) { case "a": Use(1); break; default: continue; }\n'
        '      int w = a + b * 2;\n'
        '      Func g = y => y.Z;\n'
        '      return xs[0] ?? 2;\n'
        '    }\n'
        '  }\n'
        '  struct S { int q; }\n'
        '  enum E { A }\n'
        '  interface I { }\n'
        '}\n',
        [
            '1using_directive 2identifier=System',
            '1namespace_definition 2identifier=N%1$d 2block 3comment=// note 3class_declaration 4modifier=public 4type_identifier=C%1$d 4type_identifier=B 4block 5variable_declaration 6type_identifier=int 6assignment_expression 7identifier=x 7number_literal=1 5method_declaration 6modifier=public 6identifier=C%1$d 6parameters 7parameter 8type_identifier=int 8identifier=a 6block 7assignment_expression 8field_expression 9identifier=this 9field_identifier=x 8identifier=a 5method_declaration 6modifier=public 6modifier=static 6modifier=async 6identifier=M 6type_identifier=Task 6type_identifier=int 6parameters 7parameter 8type_identifier=string 8identifier=s 7parameter 8type_identifier=List 8type_identifier=int 8identifier=xs 6block 7foreach_statement 8header 9identifier=var 9binary_expression 10identifier=i 10identifier=xs 8block 9call_expression 10identifier=Use 10arguments 11identifier=i 7if_statement 8parenthesized_expression 9binary_expression 10identifier=s 10null_literal=null 8return_statement 9number_literal=1 7try_statement 8block 9await_expression 10call_expression 11identifier=F 11arguments 12identifier=s 8catch_clause 9header 10variable_declaration 11type_identifier=E 11identifier=e 9block 10throw_statement 11identifier=e 8finally_clause 9block 10call_expression 11identifier=Done 7variable_declaration 8type_identifier=var 8assignment_expression 9identifier=v 9string_literal=@"raw "" // no" 7for_statement 8header 9variable_declaration 10type_identifier=int 10assignment_expression 11identifier=i 11number_literal=0 9binary_expression 10identifier=i 10number_literal=3 9postfix_expression 10identifier=i 8block 9call_expression 10identifier=Use 10arguments 11identifier=i 7while_statement 8parenthesized_expression 9boolean_literal=true 8block 9break_statement=break; 7switch_statement 8parenthesized_expression 9identifier=s 8block 9switch_label 10string_literal="a" 10call_expression 11identifier=Use 11arguments 12number_literal=1 10break_statement=break; 9switch_label 10continue_statement=continue; 7variable_declaration 8type_identifier=int 8assignment_expression 9identifier=w 9binary_expression 10identifier=a 10binary_expression 11identifier=b 11number_literal=2 7variable_declaration 8type_identifier=Func 8assignment_expression 9identifier=g 9lambda_expression 10identifier=y 10field_expression 11identifier=y 11field_identifier=Z 7return_statement 8binary_expression 9index_expression 10identifier=xs 10number_literal=0 9number_literal=2 3struct_item 4type_identifier=S 4block 5variable_declaration 6type_identifier=int 6identifier=q 3enum_declaration 4type_identifier=E 4block 5identifier=A 3interface_declaration 4type_identifier=I 4block={ }',
        ],
    ),
    "dart": (
        "import 'a.dart';\n"
        '// note\n'
        'class C%1$d extends B {\n'
        '  final int x = 1;\n'
        '  C%1$d(int a) { this.x = a; }\n'
        '  static int m(String s, int b) { return b + 2 * 3; }\n'
        '}\n'
        'enum E { a, b }\n'
        'mixin M { }\n'
        'void f%1$d(int a) {\n'
        '  if (a > 1) { g(a); } else { h(); }\n'
        '  for (var i = 0; i < 3; i++) { g(i); }\n'
        '  while (true) { break; }\n'
        '  do { g(1); } while (a < 2);\n'
        '  try { g(2); } catch (e) { throw e; } finally { h(); }\n'
        '  switch (a) { case 1: g(3); break; default: h(); }\n'
        '  var s = "a // no";\n'
        '  var l = [1, 2].map((x) => x * 2);\n'
        '  return a == 1 ? null : l[0];\n'
        '}\n',
        [
            "1import_declaration 2string_literal='a.dart'",
            '1comment=// note',
            '1class_declaration 2type_identifier=C%1$d 2type_identifier=extends 2type_identifier=B 2block 3variable_declaration 4identifier=int 4assignment_expression 5identifier=x 5number_literal=1 3method_declaration 4identifier=C%1$d 4parameters 5parameter 6type_identifier=int 6identifier=a 4block 5assignment_expression 6field_expression 7identifier=this 7field_identifier=x 6identifier=a 3method_declaration 4modifier=static 4identifier=m 4type_identifier=int 4parameters 5parameter 6type_identifier=String 6identifier=s 5parameter 6type_identifier=int 6identifier=b 4block 5return_statement 6binary_expression 7identifier=b 7binary_expression 8number_literal=2 8number_literal=3',
            '1enum_declaration 2type_identifier=E 2block 3identifier=a 3identifier=b',
            '1mixin_declaration 2type_identifier=M 2block={ }',
            '1function_declaration 2identifier=f%1$d 2type_identifier=void 2parameters 3parameter 4type_identifier=int 4identifier=a 2block 3if_statement 4parenthesized_expression 5binary_expression 6identifier=a 6number_literal=1 4block 5call_expression 6identifier=g 6arguments 7identifier=a 4else_clause 5block 6call_expression 7identifier=h 3for_statement 4header 5variable_declaration 6assignment_expression 7identifier=i 7number_literal=0 5binary_expression 6identifier=i 6number_literal=3 5postfix_expression 6identifier=i 4block 5call_expression 6identifier=g 6arguments 7identifier=i 3while_statement 4parenthesized_expression 5boolean_literal=true 4block 5break_statement=break; 3do_statement 4block 5call_expression 6identifier=g 6arguments 7number_literal=1 4parenthesized_expression 5binary_expression 6identifier=a 6number_literal=2 3try_statement 4block 5call_expression 6identifier=g 6arguments 7number_literal=2 4catch_clause 5header 6identifier=e 5block 6throw_statement 7identifier=e 4finally_clause 5block 6call_expression 7identifier=h 3switch_statement 4parenthesized_expression 5identifier=a 4block 5case_statement 6number_literal=1 6call_expression 7identifier=g 7arguments 8number_literal=3 6break_statement=break; 5default_statement 6call_expression 7identifier=h 3variable_declaration 4assignment_expression 5identifier=s 5string_literal="a // no" 3variable_declaration 4assignment_expression 5identifier=l 5call_expression 6field_expression 7array_expression 8number_literal=1 8number_literal=2 7field_identifier=map 6arguments 7lambda_expression 8parenthesized_expression 9identifier=x 8binary_expression 9identifier=x 9number_literal=2 3return_statement 4conditional_expression 5binary_expression 6identifier=a 6number_literal=1 5null_literal=null 5index_expression 6identifier=l 6number_literal=0',
        ],
    ),
    "slint": (
        'import { Button } from "std.slint";\n'
        '// note\n'
        'export component C%1$d inherits Window {\n'
        '  in property <int> n: 1 + 2 * 3;\n'
        '  callback clicked(int);\n'
        '  width: 100px;\n'
        '  Rectangle {\n'
        '    background: root.n > 1 ? red : blue;\n'
        '    Text { text: "a // no"; }\n'
        '  }\n'
        '  Button { clicked => { root.n += 1; f(n); } }\n'
        '  if n > 2: Text { }\n'
        '  for x in [1, 2]: Text { text: x; }\n'
        '  function g(a: int) -> int { return a; }\n'
        '}\n'
        'struct S { a: int }\n'
        'enum E { x, y }\n'
        'global G { }\n'
        '/* end */\n',
        [
            '1import_declaration 2identifier=Button 2identifier=from 2string_literal="std.slint"',
            '1comment=// note',
            '1component_definition 2modifier=export 2type_identifier=C%1$d 2type_identifier=inherits 2type_identifier=Window 2block 3property_declaration 4type_parameters 5type_identifier=int 4identifier=n 4binary_expression 5number_literal=1 5binary_expression 6number_literal=2 6number_literal=3 3callback_declaration 4call_expression 5identifier=clicked 5arguments 6identifier=int 3identifier=width 3number_literal=100px 3identifier=Rectangle 3block 4identifier=background 4conditional_expression 5binary_expression 6field_expression 7identifier=root 7field_identifier=n 6number_literal=1 5identifier=red 5identifier=blue 4identifier=Text 4block 5identifier=text 5string_literal="a // no" 3identifier=Button 3block 4lambda_expression 5identifier=clicked 5block 6assignment_expression 7field_expression 8identifier=root 8field_identifier=n 7number_literal=1 6call_expression 7identifier=f 7arguments 8identifier=n 3if_statement 4binary_expression 5identifier=n 5number_literal=2 4identifier=Text 4block={ } 3for_statement 4binary_expression 5identifier=x 5array_expression 6number_literal=1 6number_literal=2 4identifier=Text 4block 5identifier=text 5identifier=x 3function_declaration 4identifier=g 4parameters 5parameter 6identifier=a 6type_identifier=int 4type_identifier=int 4block 5return_statement 6identifier=a',
            '1struct_item 2type_identifier=S 2block 3identifier=a 3identifier=int',
            '1enum_declaration 2type_identifier=E 2block 3identifier=x 3identifier=y',
            '1global_definition 2type_identifier=G 2block={ }',
            '1comment=/* end */',
        ],
    ),
    "svelte": (
        '<script>\n'
        '  let n%1$d = 1;\n'
        '  function inc(a) { n += a; }\n'
        '</script>\n'
        '<!-- note -->\n'
        '{#if n > 1}\n'
        '  <p class="a" on:click={inc}>{n} times</p>\n'
        '{:else}\n'
        '  {#each xs as x}<b>{x.y}</b>{/each}\n'
        '{/if}\n'
        '{#await p}\n'
        '  <i>wait</i>\n'
        '{:then v}\n'
        '  {@html v}\n'
        '{/await}\n'
        '<input value="q">\n'
        '<style>p { color: red; }</style>\n',
        [
            '1script_element 2start_tag 3tag_name=script 2raw_text 3let_declaration 4assignment_expression 5identifier=n%1$d 5number_literal=1 3function_declaration 4identifier=inc 4parameters 5identifier=a 4block 5assignment_expression 6identifier=n 6identifier=a 2end_tag=</script>',
            '1comment=<!-- note -->',
            '1if_statement 2block_start 3expression=n > 1 2element 3start_tag 4tag_name=p 4attribute 5attribute_name=class 5attribute_value=a 4attribute 5attribute_name=on:click 5attribute_value={inc} 3expression=n 3text=times 3end_tag=</p> 2else_clause={:else} 2each_statement 3block_start 4expression=xs as x 3element 4start_tag 5tag_name=b 4expression=x.y 4end_tag=</b> 3block_end={/each} 2block_end={/if}',
            '1await_statement 2block_start 3expression=p 2element 3start_tag 4tag_name=i 3text=wait 3end_tag=</i> 2then_clause={:then v} 2html_expression=html v 2block_end={/await}',
            '1element 2start_tag 3tag_name=input 3attribute 4attribute_name=value 4attribute_value=q',
            '1style_element 2start_tag 3tag_name=style 2raw_text=p { color: red; } 2end_tag=</style>',
        ],
    ),
}
