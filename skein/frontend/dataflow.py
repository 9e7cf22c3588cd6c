"""Data flow of one parsed file: vertices and edges, names resolved through scopes.

Vertices are value, use, function-call, variable-definition and function-definition; edges carry the bits of
skein.operators.graph. Branches are joined by keeping all definitions that may hold; loops link what their body reads to
what it defined a round before; a function's free names are looked up where it is made and again where it is called, and
its outer assignments take effect where it is called. Flow edges lead from each statement to the ones that may follow.
Functions with a meaning of their own, such as switch, local or source, are in skein.frontend.processors.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from skein.frontend.parser import ASSIGN, Node, parse
from skein.frontend.processors import KINDS, Processors
from skein.operators.graph import ARGUMENT, CALLS, CONTROL, DEFINED_BY, DEFINED_BY_ON_CALL, DEFINES_ON_CALL, FLOW, NSE, READS, RETURNS, SIDE_EFFECT

#: Functions whose first argument is a name or is not evaluated, that leave a function, or that end a program.
LIBRARY = {"library", "require", "loadNamespace", "requireNamespace", "attachNamespace"}
QUOTING = {"quote", "bquote", "substitute", "expression", "deparse"}
STOPPING = {"stop", "abort", "quit", "q"}
PIPES = {"%>%", "%<>%", "%T>%", "%$%"}
#: Frames of recursion that the analysis of one file may take.
DEEPEST = 500_000
ASSIGNING = {"assign", "delayedAssign", "makeActiveBinding"}
#: Families of base functions, by their common beginning.
FAMILIES = {
    "as.": "Date character data.frame double environment factor function integer list logical matrix numeric vector", "is.": "character data.frame environment factor function list logical matrix na null numeric vector",
    "read.": "csv csv2 dcf delim delim2 table", "write.": "csv csv2 table", "col": "Means Sums names", "row": "Means Sums names", "cum": "max min prod sum", "which.": "max min", "seq_": "along len",
    "file.": "copy create exists info path remove", "Sys.": "Date getenv setenv sleep time", "log": "10 1p 2", "a": "cos sin tan", "is": "FALSE TRUE",
    **dict.fromkeys("rdpq", "beta binom chisq exp gamma geom nbinom norm pois t unif"),
}
#: Other base functions that scripts use most.
OTHERS = (
    "abline abs all anova any anyNA array attr barplot basename boxplot cbind ceiling character chartr class close coef cor cos cov crossprod cut "
    "data.frame density detach dev.off diff dim dir dir.create dirname download.file dQuote droplevels dump duplicated emptyenv endsWith environmentName "
    "exp expand.grid factor file floor for format formatC function getOption getwd glm gregexpr grepl gsub gzfile head hist identical identity ifelse "
    "integer integrate interaction legend length letters levels lines list.files lm log logical ls matrix max mean median merge min missing mode names "
    "nargs nchar ncol Negate nlevels noquote nrow numeric open optim options order par parse pdf plogis plot png points predict proc.time prod quantile "
    "range rank rawToChar rbind readline readLines readRDS regexpr regmatches rep replace residuals return rev rle round row.names sample save saveRDS "
    "scale scan sd seq set.seed setdiff setwd shQuote sin sink solve sort split sprintf sqrt sQuote startsWith strsplit sub substr sum suppressWarnings "
    "sweep system t t.test table tail tolower toString toupper trimws union unique unlink unlist unsplit url var vector Vectorize which write writeLines "
    "zip"
)
#: Names that are no findings where nothing defines them; calls of names that are neither these nor defined have no origin.
BUILTIN = {*OTHERS.split(), *(a + b for a, ends in FAMILIES.items() for b in ends.split()), *KINDS, *QUOTING, *STOPPING, *ASSIGNING, *LIBRARY}


@dataclass
class Function:
    node: Node
    params: list[tuple[str, int, bool]] = field(default_factory=list)
    exits: list[int] = field(default_factory=list)
    open: list[tuple[int, str]] = field(default_factory=list)
    outer: dict[str, set[int]] = field(default_factory=dict)
    name: str | None = None
    recalls: list[tuple] = field(default_factory=list)
    hooks: list[tuple] = field(default_factory=list)
    generics: list[tuple] = field(default_factory=list)


class Flow(Processors):
    """The analysis of one file; vertices: id -> (tag, name, namespace, origin, cds); edges: (src, dst) -> bits.

    `sources`: texts of files that may be sourced, by path; `kinds`: what calls of a name do, beside or instead of KINDS;
    `observe` is told of each node and each call of a kind that is visited. A subclass may replace any on_ and do_ method.
    """

    def __init__(self, root: Node, sources: Mapping[str, str] | None = None, kinds: Mapping[str, str] | None = None, observe: Callable[[str, Node], None] | None = None):
        self.root, self.observe = root, observe
        self.sources, self.kinds = dict(sources or {}), {**KINDS, **(kinds or {})}
        self.sourced: list[tuple[int, str]] = []
        self.sourcing: list[str] = []
        self.once: list[int] = []  # loops whose every way through leaves them
        self.unknown: list[int] = []  # calls that may define anything
        self.lambdas: set[int] = set()  # formulas that stand for functions
        self.skip: set[int] = set()  # symbols that are parameters of such
        self.values: dict[int, set[int]] = defaultdict(set)  # src -> dst of reads and returns
        todo, self.next_id = [root], 0
        while todo:
            x = todo.pop()
            self.next_id = max(self.next_id, x.id + 1)
            todo += [c for _, c in x.children]
        self.vertices: dict[int, tuple] = {}
        self.edges: dict[tuple[int, int], int] = {}
        self.scopes: list[dict[str, set[int]]] = [{}]
        self.frames: list[Function] = []
        self.functions: dict[int, Function] = {}
        self.holds: dict[int, set[int]] = {}  # definition -> vertices that its value comes from
        self.reads: list[tuple[int, str, frozenset[int]]] = []
        self.cds: list[tuple[int, bool]] = []
        self.libraries: list[tuple[int, str]] = []
        for _, child in root.children:
            self.visit(child)
        for f in list(self.functions.values()):
            self.late(f)
        self.follow(root.children, [], [])

    # records

    def vertex(self, node: Node, tag: str, name: str | None = None, ns: str | None = None, origin: tuple[str, ...] = ()) -> int:
        self.vertices[node.id] = (tag, name, ns, list(origin), [f"{i}:{'T' if w else 'F'}" for i, w in self.cds])
        return node.id

    def edge(self, src: int, dst: int, bits: int) -> None:
        if src != dst:
            self.edges[src, dst] = self.edges.get((src, dst), 0) | bits
            if bits & (READS | RETURNS):
                self.values[src].add(dst)

    # scopes

    def lookup(self, name: str) -> set[int]:
        for scope in reversed(self.scopes):
            if name in scope:
                return scope[name]
        return set()

    def define(self, name: str, ids: set[int], outer: bool = False) -> None:
        if not outer:
            self.scopes[-1][name] = set(ids)
            return
        for scope in reversed(self.scopes[:-1]):
            if name in scope:
                scope[name] = scope[name] | ids if self.frames else set(ids)
                break
        else:
            self.scopes[0][name] = self.scopes[0].get(name, set()) | ids
        if self.frames:
            self.frames[-1].outer.setdefault(name, set()).update(ids)

    def snapshot(self) -> list[dict[str, set[int]]]:
        # sets of definitions are replaced and never changed, so they can be shared
        return [dict(s) for s in self.scopes]

    @staticmethod
    def joined(a: list[dict[str, set[int]]], b: list[dict[str, set[int]]]) -> list[dict[str, set[int]]]:
        out = []
        for x, y in zip(a, b, strict=True):
            both = dict(x)
            for k, v in y.items():
                if both.get(k) is not v:
                    both[k] = both.get(k, set()) | v
            out.append(both)
        return out

    # expressions: each visit gives the vertices that the expression's value comes from

    def visit(self, n: Node) -> list[int]:
        handler = getattr(self, "on_" + n.type, None)
        if self.observe is not None:
            self.observe(n.type, n)
        return handler(n) if handler else []

    def on_RNumber(self, n: Node) -> list[int]:
        return [self.vertex(n, "value", n.lexeme)]

    on_RString = on_RLogical = on_RNumber

    def on_RSymbol(self, n: Node) -> list[int]:
        name = str(n.value)
        if n.id in self.skip:
            return [n.id]
        if name in ("NULL", "NA", "Inf", "NaN", "NA_integer_", "NA_real_", "NA_character_") or n.get("namespace"):
            ns = n.get("namespace")
            return [self.vertex(n, "use" if ns else "value", name, ns.lexeme if ns else None)]
        self.vertex(n, "use", name)
        self.read(n.id, name)
        return [n.id]

    def read(self, user: int, name: str) -> set[int]:
        found = self.lookup(name)
        for d in found:
            self.edge(user, d, READS)
        if not found and name not in BUILTIN:
            for d in self.unknown:
                self.edge(user, d, READS)
        if self.frames and name not in self.scopes[-1]:
            self.frames[-1].open.append((user, name))
        self.reads.append((user, name, frozenset(found)))
        return found

    def on_RExpressionList(self, n: Node) -> list[int]:
        out: list[int] = []
        for role, c in n.children:
            if role != "comment":
                out = self.visit(c)
        self.vertex(n, "function-call", n.lexeme, origin=(f"builtin:{n.lexeme}",))
        for i in out:
            self.edge(n.id, i, RETURNS | ARGUMENT)
        return [n.id]

    def operation(self, n: Node, parts: list[Node], name: str) -> list[int]:
        for p in parts:
            for i in self.visit(p):
                self.edge(n.id, i, READS | ARGUMENT)
        own = self.lookup(name)
        return [self.vertex(n, "function-call", name, origin=("function",) if own else (f"builtin:{name}",))]

    def on_RUnaryOp(self, n: Node) -> list[int]:
        if n.lexeme == "~":
            return self.do_lambda(n) if n.id in self.lambdas else self.quoted(n, [c for _, c in n.children])
        return self.operation(n, [c for _, c in n.children], n.lexeme)

    def on_RBinaryOp(self, n: Node) -> list[int]:
        left, right = n.get("binop-lhs"), n.get("binop-rhs")
        if n.lexeme in ASSIGN:
            if n.lexeme in ("->", "->>"):
                left, right = right, left
            return self.assign(n, left, right, outer=n.lexeme in ("<<-", "->>"))
        if n.lexeme == "~":
            return self.quoted(n, [left, right])
        if n.lexeme in ("&&", "||"):
            return self.lazy(n, left, right)
        if n.lexeme in PIPES and right.type == "RFunctionCall":
            out = self.on_RPipe(n)
            if n.lexeme == "%<>%" and left.type == "RSymbol":
                self.define(str(left.value), self.lookup(str(left.value)) | {n.id})
                self.holds[n.id] = set(out)
            return out
        return self.operation(n, [left, right], n.lexeme)

    def lazy(self, n: Node, left: Node, right: Node) -> list[int]:
        """The right side is evaluated only if the left one leaves the answer open."""
        tests = self.visit(left)
        before = self.snapshot()
        self.cds.append((tests[0] if tests else n.id, n.lexeme == "&&"))
        more = self.visit(right)
        self.cds.pop()
        self.scopes = self.joined(before, self.scopes)
        for i in (*tests, *more):
            self.edge(n.id, i, READS | ARGUMENT)
        return [self.vertex(n, "function-call", n.lexeme, origin=(f"builtin:{n.lexeme}",))]

    def quoted(self, n: Node, parts: list[Node]) -> list[int]:
        """Parts that are not evaluated: uses without reads."""
        for p in parts:
            todo = [p]
            while todo:
                x = todo.pop()
                todo += [c for _, c in x.children]
                if x.type == "RSymbol" and x.id not in self.vertices:
                    self.vertex(x, "use", str(x.value))
                    self.edge(n.id, x.id, NSE)
        return [self.vertex(n, "function-call", n.lexeme, origin=(f"builtin:{n.lexeme}",))]

    def on_RPipe(self, n: Node) -> list[int]:
        left, right = n.get("binop-lhs"), n.get("binop-rhs")
        if right.type != "RFunctionCall":
            return self.operation(n, [left, right], "|>")
        first = self.visit(left)
        out = self.call(right, extra=first)
        self.vertex(n, "function-call", n.lexeme, origin=(f"builtin:{n.lexeme}",))
        for i in out:
            self.edge(n.id, i, RETURNS | ARGUMENT)
        return [n.id]

    def assign(self, n: Node, target: Node, source: Node, outer: bool = False) -> list[int]:
        values = self.visit(source)
        if source.type == "RFunctionDefinition" and source.id in self.functions and target.value is not None:
            self.functions[source.id].name = str(target.value)
        if target.type == "RFunctionCall" and target.lexeme == "method" and target.all("call-argument"):
            # a method is one more function that its generic may stand for
            generic = target.all("call-argument")[0].get("arg-value")
            for d in self.lookup(str(generic.value)) if generic is not None and generic.value is not None else ():
                self.holds.setdefault(d, set()).update(values)
            return self.operation(n, [], n.lexeme)
        inner, old = target, False
        while inner.type in ("RAccess", "RFunctionCall"):
            # x$a <- v and names(x) <- v change x and keep the rest of it
            old = True
            for role, c in inner.children:
                if role == "index-access" and inner.lexeme not in ("$", "@"):
                    self.visit(c)
            args = inner.all("call-argument")
            nxt = inner.get("accessed") if inner.type == "RAccess" else (args[0].get("arg-value") if args else None)
            if nxt is None:
                return self.operation(n, [], n.lexeme)
            inner = nxt
        name = str(inner.value) if inner.value is not None else inner.lexeme
        before = self.lookup(name) if old else set()
        self.vertex(inner, "variable-definition", name)
        for i in values:
            self.edge(inner.id, i, DEFINED_BY)
        for d in before:
            self.edge(inner.id, d, READS)
        self.vertex(n, "function-call", n.lexeme if n.type == "RBinaryOp" else n.get("call-name").lexeme, origin=("builtin:" + (n.lexeme if n.type == "RBinaryOp" else "assign"),))
        self.edge(inner.id, n.id, DEFINED_BY)
        self.edge(n.id, inner.id, RETURNS | ARGUMENT)
        for i in values:
            self.edge(n.id, i, ARGUMENT)
        self.holds[inner.id] = set(values)
        self.define(name, {inner.id}, outer)
        return [n.id]

    def on_RAccess(self, n: Node) -> list[int]:
        for i in self.visit(n.get("accessed")):
            self.edge(n.id, i, READS | RETURNS | ARGUMENT)
        for a in n.all("index-access"):
            value = a.get("arg-value")
            if value is None:
                continue
            if n.lexeme == "[" and value.type == "RBinaryOp" and value.lexeme == ":=":
                self.table_assignment(n, value)
            elif n.lexeme in ("$", "@") and value.type == "RSymbol":
                self.vertex(value, "value", value.lexeme)
                self.edge(n.id, value.id, ARGUMENT)
            else:
                for i in self.visit(value):
                    self.edge(n.id, i, READS | ARGUMENT)
        return [self.vertex(n, "function-call", n.lexeme, origin=(f"builtin:{n.lexeme}",))]

    def on_RArgument(self, n: Node) -> list[int]:
        value = n.get("arg-value")
        return self.visit(value) if value else []

    # calls

    def on_RFunctionCall(self, n: Node) -> list[int]:
        return self.call(n)

    def call(self, n: Node, extra: list[int] | None = None) -> list[int]:
        callee, args = n.get("call-name"), n.all("call-argument")
        if callee.type not in ("RSymbol", "RString"):
            for i in self.visit(callee):
                self.edge(n.id, i, READS | CALLS)
            self.vertex(n, "function-call", None, origin=("function",) if callee.type != "RAccess" else ("unnamed",))
            self.into_functions(n, self.functions_of(self.visit_values(callee)), self.arguments(n, args, extra))
            return [n.id]
        name = str(callee.value)
        ns = callee.get("namespace")
        values = [a.get("arg-value") for a in args]
        if name in LIBRARY and values and values[0] is not None and values[0].type in ("RSymbol", "RString"):
            self.vertex(values[0], "value", str(values[0].value))
            self.libraries.append((n.id, str(values[0].value)))
            self.vertex(n, "function-call", name, origin=(f"builtin:{name}",))
            self.edge(n.id, values[0].id, ARGUMENT)
            return [n.id]
        if name in QUOTING:
            return self.quoted(n, [v for v in values if v is not None])
        if name in ASSIGNING and len(values) > 1 and values[0] is not None and values[0].type == "RString":
            return self.assign(n, values[0], values[1])
        kind = self.kinds.get(name)
        if kind is not None and (ns is not None or not self.lookup(name)):
            if self.observe is not None:
                self.observe(kind, n)
            return getattr(self, "do_" + kind.replace("-", "_"))(n, name, args, extra)
        given = self.arguments(n, args, extra)
        defs = set() if ns else self.lookup(name)
        functions = self.functions_of(defs)
        known = ns is not None or name in BUILTIN
        origin = ("function",) if defs else ((f"builtin:{name}",) if known else ())
        self.vertex(n, "function-call", name, ns.lexeme if ns else None, origin)
        if not ns:
            self.read(n.id, name)
        if not defs:
            for _, ids in given:
                for i in ids:
                    self.edge(n.id, i, READS)
            if name == "return" and self.frames:
                self.frames[-1].exits += [i for _, ids in given for i in ids] or [n.id]
                for _, ids in given:
                    for i in ids:
                        self.edge(n.id, i, RETURNS)
        self.into_functions(n, functions, given)
        return [n.id]

    def arguments(self, n: Node, args: list[Node], extra: list[int] | None) -> list[tuple[str | None, list[int]]]:
        out: list[tuple[str | None, list[int]]] = [(None, list(extra))] if extra else []
        for a in args:
            label = a.get("arg-name")
            out.append((str(label.value) if label else None, self.visit(a)))
        for _, ids in out:
            for i in ids:
                self.edge(n.id, i, ARGUMENT)
        return out

    def visit_values(self, n: Node) -> set[int]:
        return {n.id} if n.id in self.vertices else set()

    def functions_of(self, ids: set[int]) -> list[Function]:
        """The functions that definitions or values may hold."""
        seen, todo, out = set(), list(ids), []
        while todo:
            i = todo.pop()
            if i in seen:
                continue
            seen.add(i)
            if i in self.functions:
                out.append(self.functions[i])
            todo += self.holds.get(i, ())
            if i not in self.holds and self.vertices.get(i, ("",))[0] in ("use", "function-call"):
                todo += self.values.get(i, ())
        return sorted(out, key=lambda f: f.node.id)

    def into_functions(self, n: Node, functions: list[Function], given: list[tuple[str | None, list[int]]]) -> None:
        for f in functions:
            self.edge(n.id, f.node.id, CALLS)
            for x in f.exits:
                self.edge(n.id, x, RETURNS)
            for param, ids in matched(given, [p for p, _, _ in f.params]):
                place = next((i for p, i, _ in f.params if p == param), None)
                for i in ids:
                    if place is not None:
                        self.edge(place, i, DEFINED_BY_ON_CALL)
                        self.edge(i, place, DEFINES_ON_CALL)
            self.late(f)
            self.effects(n, f, set())
            for m, generic, _ in f.generics:
                self.into_methods(m, self.methods(f, generic), given)

    def effects(self, n: Node, f: Function, seen: set[int]) -> None:
        """Outer assignments of a function, and of the functions that it calls, take effect where it is called."""
        if f.node.id in seen:
            return
        seen.add(f.node.id)
        for name, ids in f.outer.items():
            self.define(name, self.lookup(name) | ids)
            for i in ids:
                self.edge(n.id, i, SIDE_EFFECT)
        for user, name in f.open:
            if self.vertices.get(user, ("",))[0] == "function-call":
                for g in self.functions_of(self.lookup(name)):
                    self.effects(n, g, seen)

    def methods(self, f: Function, generic: str | None) -> list[Function]:
        """The functions that a generic's dispatch may go to; of a method, the others of its generic."""
        if generic is None:
            if f.name is None or "." not in f.name:
                return []
            generic = f.name.split(".", 1)[0]
        names = {k for s in self.scopes for k in s if k.startswith(generic + ".")}
        return [g for g in self.functions_of({d for k in names for d in self.lookup(k)}) if g is not f]

    def into_methods(self, n: Node, methods: list[Function], given: list[tuple[str | None, list[int]]]) -> None:
        for g in methods:
            self.edge(n.id, g.node.id, CALLS)
            for x in g.exits:
                self.edge(n.id, x, RETURNS)
            for param, ids in matched(given, [p for p, _, _ in g.params]):
                place = next((i for p, i, _ in g.params if p == param), None)
                for i in ids:
                    if place is not None:
                        self.edge(place, i, DEFINED_BY_ON_CALL)
                        self.edge(i, place, DEFINES_ON_CALL)

    def late(self, f: Function) -> None:
        """Links a function's free names to what they mean now."""
        for user, name in f.open:
            found = self.lookup(name)
            for d in found:
                self.edge(user, d, READS)
            if self.vertices.get(user, ("",))[0] == "function-call":
                for g in self.functions_of(found):
                    self.edge(user, g.node.id, CALLS)
                    for x in g.exits:
                        self.edge(user, x, RETURNS)
        for m, generic, given in f.generics:
            self.into_methods(m, self.methods(f, generic), given)

    def on_RFunctionDefinition(self, n: Node) -> list[int]:
        f = Function(n)
        self.functions[n.id] = f
        cds, self.cds = self.cds, []
        self.scopes.append({})
        self.frames.append(f)
        for p in n.all("function-def-param"):
            name = p.get("param-name")
            self.vertex(name, "variable-definition", name.lexeme)
            self.scopes[-1][str(name.value)] = {name.id}
            f.params.append((str(name.value), name.id, p.get("param-value") is not None))
        for p in n.all("function-def-param"):
            default = p.get("param-value")
            if default is not None:
                for i in self.visit(default):
                    self.edge(p.get("param-name").id, i, DEFINED_BY)
        f.exits += self.visit(n.get("function-def-body"))
        for hook, args in f.hooks:
            for a in args:
                for i in self.visit(a):
                    self.edge(hook.id, i, ARGUMENT | READS)
        for again, given in f.recalls:
            self.edge(again.id, n.id, CALLS)
            for x in f.exits:
                self.edge(again.id, x, RETURNS)
            for param, ids in matched(given, [p for p, _, _ in f.params]):
                for i in ids:
                    for place in (q for p, q, _ in f.params if p == param):
                        self.edge(place, i, DEFINED_BY_ON_CALL)
                        self.edge(i, place, DEFINES_ON_CALL)
        self.frames.pop()
        self.scopes.pop()
        self.cds = cds
        self.vertex(n, "function-definition", None)
        if self.frames:
            own = self.scopes[-1]
            self.frames[-1].open += [(u, x) for u, x in f.open if x not in own]
        return [n.id]

    # control

    def on_RIfThenElse(self, n: Node) -> list[int]:
        cond, then, other = n.get("if-cond"), n.get("if-then"), n.get("if-otherwise")
        tests = self.visit(cond)
        for i in tests:
            self.edge(n.id, i, READS | ARGUMENT)
        fixed = cond.value if cond.type == "RLogical" else None
        before, out = self.snapshot(), []
        after = []
        for branch, when in ((then, True), (other, False)):
            if fixed is not None and fixed != when:
                continue
            self.scopes = [dict(s) for s in before]
            if branch is not None:
                if fixed is None:
                    self.cds.append((tests[0] if tests else n.id, when))
                out += self.visit(branch)
                if fixed is None:
                    self.cds.pop()
            after.append(self.snapshot())
        self.scopes = after[0] if len(after) == 1 else self.joined(*after) if after else before
        self.vertex(n, "function-call", "if", origin=("builtin:if",))
        for i in out:
            self.edge(n.id, i, RETURNS | ARGUMENT)
        return [n.id]

    def loop(self, n: Node, body: Node, name: str, by: int, maybe: bool = True) -> list[int]:
        """A loop whose body depends on vertex `by`. Its value is NULL, so nothing comes from the body."""
        before, seen = self.snapshot(), len(self.reads)
        self.cds.append((by, True))
        self.visit(body)
        self.cds.pop()
        after = self.snapshot()
        early = {k for s in before for k in s}
        for user, x, found in self.reads[seen:]:
            old = next((s[x] for s in reversed(before) if x in s), set())
            if found <= old or (x not in early and not found):
                for d in next((s[x] for s in reversed(after) if x in s), set()):
                    self.edge(user, d, READS)
        self.scopes = self.joined(before, after) if maybe else after
        return [self.vertex(n, "function-call", name, origin=(f"builtin:{name}",))]

    def on_RForLoop(self, n: Node) -> list[int]:
        over = self.visit(n.get("for-vector"))
        var = n.get("for-variable")
        self.vertex(var, "variable-definition", var.lexeme)
        for i in over:
            self.edge(var.id, i, DEFINED_BY)
            self.edge(n.id, i, READS | ARGUMENT)
        self.define(str(var.value), {var.id})
        self.edge(n.id, var.id, ARGUMENT)
        return self.loop(n, n.get("for-body"), "for", var.id)

    def on_RWhileLoop(self, n: Node) -> list[int]:
        seen = len(self.reads)
        tests = self.visit(n.get("while-cond"))
        for i in tests:
            self.edge(n.id, i, READS | ARGUMENT)
        cond = self.reads[seen:]
        out = self.loop(n, n.get("while-body"), "while", tests[0] if tests else n.id)
        for user, name, _ in cond:
            for d in self.lookup(name):
                self.edge(user, d, READS)
        return out

    def on_RRepeatLoop(self, n: Node) -> list[int]:
        return self.loop(n, n.get("repeat-body"), "repeat", n.id, maybe=False)

    def on_RBreak(self, n: Node) -> list[int]:
        return [self.vertex(n, "function-call", n.lexeme, origin=(f"builtin:{n.lexeme}",))]

    on_RNext = on_RBreak

    # order of statements

    def follow(self, children: list[tuple[str, Node]], before: list[int], leave: list) -> list[int]:
        """Flow edges through statements; gives the ids after which the next one comes."""
        for role, c in children:
            if role != "comment":
                before = self.step(c, before, leave)
        return before

    def step(self, n: Node, before: list[int], leave: list) -> list[int]:
        for b in before:
            self.edge(b, n.id, FLOW)
        self.bodies(n)
        if n.type == "RExpressionList":
            return self.follow(n.children, [n.id], leave)
        if n.type == "RIfThenElse":
            cond = n.get("if-cond")
            fixed = cond.value if cond.type == "RLogical" else None
            out: list[int] = []
            for branch, when in ((n.get("if-then"), True), (n.get("if-otherwise"), False)):
                if fixed is not None and fixed != when:
                    if branch is not None:
                        self.step(branch, [], leave)
                    continue
                out += self.step(branch, [n.id], leave) if branch is not None else [n.id]
            return out
        if n.type in ("RForLoop", "RWhileLoop", "RRepeatLoop"):
            body = n.get({"RForLoop": "for-body", "RWhileLoop": "while-body", "RRepeatLoop": "repeat-body"}[n.type])
            breaks, again = [], []
            ends = self.step(body, [n.id], [n.id, breaks, again])
            for x in ends:
                self.edge(x, n.id, FLOW)
            if not ends and not again:
                self.once.append(n.id)
            cond = n.get("while-cond")
            endless = n.type == "RRepeatLoop" or (cond is not None and cond.value is True)
            return breaks if endless else [n.id, *breaks]
        if n.type == "RBreak" and leave:
            leave[1].append(n.id)
            return []
        if n.type == "RNext" and leave:
            self.edge(n.id, leave[0], FLOW)
            leave[2].append(n.id)
            return []
        if n.type == "RFunctionCall":
            name = n.get("call-name").value
            first = next((a.get("arg-value") for a in n.all("call-argument")), None)
            if name in STOPPING | {"return"} or (name == "stopifnot" and first is not None and first.value is False):
                return []
        return [n.id]

    def in_order(self, backward: bool = False) -> Iterator[int]:
        """The statements along the flow, breadth first from the beginnings, or from the ends backward; each once."""
        after: dict[int, list[int]] = defaultdict(list)
        ends = set()
        for (src, dst), bits in self.edges.items():
            if bits & FLOW:
                a, b = (dst, src) if backward else (src, dst)
                after[a].append(b)
                ends |= {a, b}
        entered = {y for x in after.values() for y in x}
        todo = sorted(ends - entered) or sorted(ends)[:1]
        seen = set(todo)
        for x in todo:
            yield x
            for y in sorted(after[x]):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)

    def unreached(self) -> list[int]:
        """Statements of the file and of blocks that no way from the file's or a function's beginning comes to."""
        after: dict[int, list[int]] = defaultdict(list)
        for (src, dst), bits in self.edges.items():
            if bits & FLOW:
                after[src].append(dst)
        first = next((c.id for role, c in self.root.children if role != "comment"), None)
        todo = [d for (_, d), bits in self.edges.items() if bits & CONTROL] + ([] if first is None else [first])
        seen = set(todo)
        while todo:
            for y in after[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out, nodes = [], [self.root]
        while nodes:
            x = nodes.pop()
            if x.type == "RExpressionList" and x.lexeme != "(":
                out += [c.id for role, c in x.children if role == "expr-list-child" and c.type != "RError" and c.id not in seen]
            nodes += [c for role, c in x.children if role != "inlined"]
        return sorted(out)

    def bodies(self, n: Node) -> None:
        """Flow inside the functions that a statement defines, entered by a control edge."""
        todo = [n] if n.type not in ("RExpressionList", "RIfThenElse", "RForLoop", "RWhileLoop", "RRepeatLoop") else [n.get(r) for r in ("if-cond", "for-vector", "while-cond") if n.get(r)]
        while todo:
            x = todo.pop()
            if x.type == "RFunctionDefinition":
                body = x.get("function-def-body")
                self.edge(x.id, body.id, CONTROL)
                self.step(body, [], [])
            else:
                todo += [c for _, c in x.children]


def matched(given: list[tuple[str | None, list[int]]], formals: list[str]) -> list[tuple[str, list[int]]]:
    """Arguments by formal: exact names, unique beginnings before `...`, positions, the rest to `...`."""
    out, rest, free = [], [], list(formals)
    for name, ids in given:
        if name in free:
            out.append((name, ids))
            free.remove(name)
        else:
            rest.append((name, ids))
    early = free[: free.index("...")] if "..." in free else list(free)
    later = []
    for name, ids in rest:
        fits = [f for f in early if name and f.startswith(name)]
        if len(fits) == 1:
            out.append((fits[0], ids))
            early.remove(fits[0])
        else:
            later.append((name, ids))
    for name, ids in later:
        if name is None and early:
            out.append((early.pop(0), ids))
        elif "..." in free:
            out.append(("...", ids))
    return out


def analyse(text: str, sources: Mapping[str, str] | None = None, kinds: Mapping[str, str] | None = None) -> Flow:
    """The flow of a file's text. Deep nesting is no problem: Python's limit on recursion is lifted meanwhile, which costs
    heap and no stack."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, DEEPEST))
    try:
        return Flow(parse(text), sources, kinds)
    finally:
        sys.setrecursionlimit(limit)
