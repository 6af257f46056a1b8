"""Small sources with the findings that are due in them, worked out by hand.

The pack queries deal these sources to the parts, and their SQL joins the lists
below, so the expected findings do not come from the packs.
"""

RUST_LOGIC = '''fn run() {
    panic!("no");
    todo!();
    unimplemented!();
    let a = x.unwrap();
    let b = y.unwrap_err();
    let c = z.expect("");
    let d = z.expect("error");
    unsafe { go() }
    if ok == true { }
    if ok == false { }
    let v = Vec::new();
    let m = HashMap::new();
    let s = n.to_string();
    let o = p.partial_cmp(q);
    let f = v.first().unwrap();
    let l = v.last().unwrap();
    let w = g.node_weight(i);
    let k = h.clone();
    // TODO: more
    // FIXME
}
unsafe fn raw() {}
'''

RUST_SAFE = '''fn safe(o: Option<u8>) {
    if o.is_some() {
        o.unwrap();
    }
    // SAFETY: checked above
    unsafe { go() }
    for i in items {
        let a = i.clone();
        let t = "panic!(now)";
    }
}
#[cfg(test)]
mod tests {
    #[test]
    fn t() { panic!("x"); }
}
fn after() { todo!(); }
'''

PYTHON_LOGIC = '''async def go(items):
    for i in items:
        await send(i)
    rows.sort(key=lambda r: r.get(1))
    half = n // 2
    [send_mail(x) for x in items]
    f = open(path)
    # TODO later
'''

SECRETS = '''let password = "x1";
password="x2"
let api_key = "k";
let secret_key = "k";
let token = "t";
let private_key = "p";
-----BEGIN RSA PRIVATE KEY-----
BEGIN PRIVATE KEY
concat!("a", b)
q("SELECT * FROM t")
SELECT * FROM t
INSERT INTO t
'''

SYSTEM = '''use std::process::Command;
std::process::Command::new(x)
cmd.args([a])
let p = x.."
open(../etc)
std::fs::read(p)
std::fs::write(p, d)
md5::compute(d)
sha1::compute(d)
let c = DES.new(k)
let c = DESK
RC4(k)
bind(0.0.0.0)
get(http://a)
std::mem::transmute(x)
std::hint::unreachable_unchecked()
debug_assert!(x)
if password == given
if token == Kind::End
if secret == s
if api_key == k
'''

SCRIPTS = '''eval(x)
obj.exec(x)
exec(x)
new Function(a)
pickle.loads(d)
pickle.load(f)
marshal.loads(d)
yaml.load(f)
Math.random()
random.randint(1, 2)
random.choice(a)
rand::thread_rng()
a.innerHTML = b
a.outerHTML = b
document.write(x)
o.__proto__ = p
Object.assign(a, b)
new Buffer(4)
tempfile.mktemp()
open(/tmp/x)
Access-Control-Allow-Origin: *
cors({ origin: '*' })
get(u, verify=False)
ssl.CERT_NONE
{ rejectUnauthorized: false }
run(c, shell=True)
os.system(c)
app.run(debug=True)
DEBUG = True
assert x
# eval(x)
print("eval(x)")
'''

UNKNOWN = '''val password = 'x'
val api_key="x"
secret_key = "x"
token = "x"
private_key = "x"
BEGIN RSA PRIVATE KEY
ADMIN_PASSWORD = "x"
API_KEY = "x"
q = "SELECT * FROM t WHERE id = ${id}"
q = "SELECT * FROM t WHERE id = #{id}"
q = "INSERT INTO t VALUES (${v})"
q = "DELETE FROM t WHERE a = ${v}"
q = "UPDATE t SET a = ${v}"
Runtime.getRuntime().exec("ls " + x)
system("ls + x)
x = `ls ${d}`
subprocess.run(c, shell = True)
os.system (c)
eval("1")
exec('1')
new  Function(a)
open(../x)
open(..\\x)
if given == ROOT_PASSWORD
Math.random ()
rand()
val name = "John"
'''

RUST_ITEMS = '''use std::io;
pub struct A { x: u8 }
enum B { C }
pub(crate) trait D {}
impl D for A {}
let use_it = 1;
struct E;
'''

BROKEN = '''fn broken( {
    panic!("x");
}
'''

FROM_ELSEWHERE = '''const m = require("./" + name);
import x from "https://a.b/c.js";
curl -s https://a.b/i.sh | bash
// require("a" + b)
'''

SOURCES = [("rust", RUST_LOGIC), ("rust", RUST_SAFE), ("python", PYTHON_LOGIC), ("rust", SECRETS), ("rust", SYSTEM), ("python", SCRIPTS), ("unknown", UNKNOWN), ("rust", RUST_ITEMS), ("rust", BROKEN), ("javascript", FROM_ELSEWHERE)]

#: (source, line, rule) of the logic pack.
LOGIC = [
    (0, 2, "LOGIC001"), (0, 3, "LOGIC002"), (0, 4, "LOGIC003"), (0, 5, "LOGIC010"), (0, 6, "LOGIC011"), (0, 7, "LOGIC020"), (0, 8, "LOGIC021"), (0, 9, "LOGIC030"),
    (0, 10, "LOGIC040"), (0, 11, "LOGIC041"), (0, 12, "LOGIC070"), (0, 13, "LOGIC071"), (0, 14, "LOGIC061"), (0, 15, "LOGIC090"), (0, 16, "LOGIC010"), (0, 16, "LOGIC091"),
    (0, 17, "LOGIC010"), (0, 17, "LOGIC092"), (0, 18, "LOGIC093"), (0, 19, "LOGIC060"), (0, 20, "LOGIC050"), (0, 21, "LOGIC051"), (0, 23, "LOGIC031"),
    (1, 8, "LOGIC060"), (1, 8, "LOGIC061"), (1, 17, "LOGIC002"),
    (2, 3, "LOGIC080"), (2, 4, "LOGIC081"), (2, 5, "LOGIC082"), (2, 6, "LOGIC083"), (2, 7, "LOGIC084"), (2, 8, "LOGIC050"),
    (8, 2, "LOGIC001"),
]

#: (source, line, rule) of the security pack.
SECURITY = [
    (3, 1, "SEC001"), (3, 2, "SEC001"), (3, 3, "SEC002"), (3, 4, "SEC003"), (3, 5, "SEC004"), (3, 6, "SEC005"), (3, 7, "SEC006"), (3, 8, "SEC006"), (3, 9, "SEC011"), (3, 11, "SEC012"), (3, 12, "SEC013"),
    (4, 1, "SEC020"), (4, 2, "SEC020"), (4, 3, "SEC021"), (4, 4, "SEC030"), (4, 5, "SEC030"), (4, 6, "SEC031"), (4, 7, "SEC032"), (4, 8, "SEC040"), (4, 9, "SEC041"), (4, 10, "SEC042"), (4, 12, "SEC043"),
    (4, 13, "SEC050"), (4, 14, "SEC051"), (4, 15, "SEC060"), (4, 16, "SEC061"), (4, 17, "SEC070"), (4, 18, "SEC080"), (4, 20, "SEC080"), (4, 21, "SEC080"),
    (5, 1, "SEC090"), (5, 3, "SEC091"), (5, 4, "SEC092"), (5, 5, "SEC100"), (5, 6, "SEC100"), (5, 7, "SEC101"), (5, 8, "SEC102"), (5, 9, "SEC110"), (5, 10, "SEC111"), (5, 11, "SEC111"), (5, 12, "SEC112"),
    (5, 13, "SEC120"), (5, 14, "SEC121"), (5, 15, "SEC122"), (5, 16, "SEC130"), (5, 17, "SEC131"), (5, 18, "SEC140"), (5, 19, "SEC150"), (5, 20, "SEC151"), (5, 21, "SEC160"), (5, 22, "SEC160"),
    (6, 3, "SEC003"), (6, 4, "SEC004"), (6, 5, "SEC005"), (6, 6, "SEC006"), (6, 19, "SEC090"), (6, 20, "SEC091"), (6, 22, "SEC030"),
    (5, 23, "SEC170"), (5, 24, "SEC171"), (5, 25, "SEC172"), (5, 26, "SEC180"), (5, 27, "SEC181"), (5, 28, "SEC190"), (5, 29, "SEC190"), (5, 30, "SEC200"),
]

#: (source, line, rule) of the rules for unknown languages in source 6.
FALLBACK = [
    (6, 1, "SEC001"), (6, 2, "SEC002"), (6, 3, "SEC003"), (6, 4, "SEC004"), (6, 5, "SEC005"), (6, 6, "SEC006"), (6, 7, "SEC001"), (6, 8, "SEC002"), (6, 9, "SEC010"), (6, 10, "SEC010"), (6, 11, "SEC010"),
    (6, 12, "SEC010"), (6, 13, "SEC010"), (6, 14, "SEC020"), (6, 14, "SEC091"), (6, 15, "SEC020"), (6, 16, "SEC021"), (6, 17, "SEC180"), (6, 18, "SEC181"), (6, 19, "SEC090"), (6, 20, "SEC091"),
    (6, 21, "SEC092"), (6, 22, "SEC030"), (6, 23, "SEC030"), (6, 24, "SEC080"), (6, 25, "SEC110"), (6, 26, "SEC110"),
]

#: (source, line, rule) of kinds of items, the first of each kind in a file.
ITEMS = [(4, 1, "AST005"), (7, 1, "AST005"), (7, 2, "AST001"), (7, 3, "AST002"), (7, 4, "AST003"), (7, 5, "AST004")]

#: (source, line, rule) of code from elsewhere, and of brackets that do not close.
SUPPLY = [(9, 1, "SUPP004"), (9, 2, "SUPP005"), (9, 3, "SUPP006")]
SYNTAX = [(8, 1, "SYNTAX001")]

KERNEL = '"metadata": {"kernelspec": {"name": "p", "language": "python", "display_name": "P"}, "language_info": {"name": "python"}}'
NOTEBOOKS = [
    "{",
    "[]",
    "{}",
    '{"nbformat": 2, "nbformat_minor": 0, "metadata": {}, "cells": []}',
    '{"nbformat": 4, "nbformat_minor": 5, "metadata": [], "cells": {}}',
    '{"nbformat": 4, "nbformat_minor": 2, "metadata": {"kernelspec": {"name": "p"}, "language_info": {}}, "cells": [1, {"source": "x"}, {"cell_type": "odd"}, {"cell_type": "code", "source": [" "]}]}',
    '{"nbformat": 3, "metadata": {"kernelspec": 7}, "cells": [{"cell_type": "code", "source": ["%%nope\\n", "x"], "outputs": {}, "execution_count": 1.5}]}',
    '{"nbformat": 4, "nbformat_minor": 4, ' + KERNEL + ', "cells": [{"cell_type": "code", "source": "%%bash\\nls", "outputs": [{"output_type": "error"}, {"output_type": "stream"}], "execution_count": 3}, {"cell_type": "markdown", "source": "# t"}]}',
    '{"nbformat": 4, "nbformat_minor": 4, ' + KERNEL + ', "cells": [{"cell_type": "code", "source": ["%time x"], "outputs": [], "execution_count": null}]}',
]
#: (notebook, issue, cell).
NOTEBOOK_ISSUES = [
    (0, "NB001", None), (1, "NB006", None), (1, "NB008", None), (2, "NB003", None), (2, "NB004", None), (2, "NB008", None), (3, "NB002", None), (3, "NB011", None), (3, "NB013", None),
    (4, "NB005", None), (4, "NB007", None), (5, "NB009", None), (5, "NB009", None), (5, "NB012", None), (5, "NB014", 0), (5, "NB016", 1), (5, "NB015", 2), (5, "NB017", 3),
    (6, "NB010", None), (6, "NB018", 0), (6, "NB019", 0), (6, "NB020", 0), (7, "NB021", 0),
]
