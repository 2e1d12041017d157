"""Recursive descent over clauses and patterns, precedence climbing over expressions."""

from __future__ import annotations

from ..errors import QuerySyntaxError, outside
from . import ast as A
from .lexer import RESERVED, Token, tokenize

#: Binding powers of infix operators, weakest first; comparisons chain.
POWERS = {"OR": 10, "XOR": 20, "AND": 30, "=": 40, "<>": 40, "!=": 40, "<": 40, "<=": 40, ">": 40, ">=": 40, "IN": 45, "STARTS": 45, "ENDS": 45, "CONTAINS": 45, "IS": 45, "+": 50, "-": 50, "*": 60, "/": 60, "%": 60, "^": 70}
NOT_POWER, NEGATE_POWER = 40, 80
COMPARISONS = ("=", "<>", "<", "<=", ">", ">=")
QUANTIFIERS = ("any", "all", "none", "single")
NAMESPACES = ("date", "time", "localtime", "datetime", "localdatetime", "duration")
MAX_STEPS = 200_000
LARGEST = (1 << 63) - 1


class Parser:
    """``extended`` also takes the clauses beyond the basic language."""

    def __init__(self, text: str, extended: bool = False):
        self.tokens, self.at, self.extended, self.steps = tokenize(text), 0, extended, 0

    # -- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def step(self) -> Token:
        self.steps += 1
        if self.steps > MAX_STEPS:
            raise QuerySyntaxError("ParserComplexityLimitExceeded")
        token = self.now
        self.at += token.kind != "end"
        return token

    def word(self, *words: str) -> bool:
        """Take the words if they come next."""
        if all(self.ahead(i).word == w for i, w in enumerate(words)):
            for _ in words:
                self.step()
            return True
        return False

    def op(self, text: str) -> bool:
        if self.now.kind == "op" and self.now.text == text:
            self.step()
            return True
        return False

    def peek(self, text: str, n: int = 0) -> bool:
        return self.ahead(n).kind == "op" and self.ahead(n).text == text

    def need(self, text: str) -> None:
        if not self.op(text):
            raise QuerySyntaxError(f"expected {text!r}, found {self.now.text or 'the end'!r}")

    def need_word(self, text: str) -> None:
        if not self.word(text):
            raise QuerySyntaxError(f"expected {text}, found {self.now.text or 'the end'!r}")

    def variable(self) -> str:
        token = self.step()
        if token.kind == "quoted" or token.kind == "name" and token.word not in RESERVED:
            return str(token.value)
        raise QuerySyntaxError(f"expected a name, found {token.text or 'the end'!r}")

    def key(self) -> str:
        """A property key, label or type: keywords will do."""
        token = self.step()
        if token.kind in ("name", "quoted", "int"):
            return str(token.value)
        raise QuerySyntaxError(f"expected a name, found {token.text or 'the end'!r}")

    def allowed(self, what: str) -> None:
        if not self.extended:
            raise outside(what)

    # -- clauses

    def parse(self) -> A.Query:
        explain = self.word("EXPLAIN")
        query = self.single()
        query.explain = explain
        last = query
        while self.now.word == "UNION":
            self.allowed("UNION")
            self.step()
            every = self.word("ALL")
            last.union = (self.single(), every)
            last = last.union[0]
        if not self.op(";") and self.now.kind != "end":
            raise QuerySyntaxError(f"unexpected {self.now.text!r}")
        return query

    def single(self) -> A.Query:
        query = A.Query()
        while self.now.kind != "end" and not self.peek(";") and self.now.word != "UNION":
            query.clauses.append(self.clause())
        if not query.clauses:
            raise QuerySyntaxError("empty query")
        return query

    def clause(self):
        if self.word("MATCH"):
            return A.Match(self.patterns())
        if self.word("WHERE"):
            return A.Where(self.expression())
        if self.word("RETURN"):
            return self.projection(True)
        if self.word("CREATE"):
            return A.Create(self.patterns())
        if self.word("SET"):
            return A.SetProps(self.separated(self.assignment))
        if self.now.word == "DELETE" or self.now.word == "DETACH" and self.ahead().word == "DELETE":
            detach = self.word("DETACH")
            self.step()
            return A.Delete(self.separated(self.expression), detach)
        if self.now.word == "OPTIONAL":
            self.allowed("OPTIONAL MATCH")
            self.step()
            self.need_word("MATCH")
            patterns = self.patterns()
            return A.Match(patterns, optional=True, where=self.expression() if self.word("WHERE") else None)
        if self.now.word == "WITH":
            self.allowed("WITH")
            self.step()
            return self.projection(False)
        if self.now.word == "UNWIND":
            self.allowed("UNWIND")
            self.step()
            expr = self.expression()
            self.need_word("AS")
            return A.Unwind(expr, self.variable())
        if self.now.word in ("MERGE", "CALL", "REMOVE", "FOREACH"):
            raise outside(self.now.word)
        raise QuerySyntaxError(f"unexpected {self.now.text!r}")

    def separated(self, part) -> tuple:
        out = [part()]
        while self.op(","):
            out.append(part())
        return tuple(out)

    def assignment(self) -> tuple[str, str, A.Expr]:
        bracket = self.op("(")
        name = self.variable()
        if bracket:
            self.need(")")
        if self.peek(":"):
            raise outside("SET of a label")
        if self.peek("=") or self.peek("+="):
            raise outside("SET of a map")
        self.need(".")
        key = self.key()
        self.need("=")
        return name, key, self.expression()

    def projection(self, final: bool) -> A.Projection:
        distinct = self.now.word == "DISTINCT"
        if distinct:
            self.allowed("DISTINCT")
            self.step()
        star = self.op("*")
        items: tuple = () if star and not self.op(",") else self.separated(self.item)
        order: tuple = ()
        skip = limit = None
        if self.now.word == "ORDER":
            self.allowed("ORDER BY")
            self.step()
            self.need_word("BY")
            order = self.separated(self.sort_item)
        if self.now.word == "SKIP":
            self.allowed("SKIP")
            self.step()
            skip = self.expression()
        if self.word("LIMIT"):
            limit = self.expression()
        return A.Projection(items, star, final, distinct, order, skip, limit)

    def item(self) -> A.Item:
        expr = self.expression()
        if self.word("AS"):
            return A.Item(expr, self.variable())
        if self.now.kind == "quoted" or self.now.kind == "name" and self.now.word not in RESERVED:
            return A.Item(expr, self.variable())
        return A.Item(expr, None)

    def sort_item(self) -> tuple[A.Expr, bool]:
        expr = self.expression()
        for word, up in (("ASC", True), ("ASCENDING", True), ("DESC", False), ("DESCENDING", False)):
            if self.word(word):
                return expr, up
        return expr, True

    # -- patterns

    def patterns(self) -> tuple[A.Pattern, ...]:
        return self.separated(self.pattern)

    def pattern(self) -> A.Pattern:
        if self.now.kind == "name" and self.ahead().text == "(" and self.now.text.lower() in ("shortestpath", "allshortestpaths"):
            raise outside(self.now.text)
        if self.now.kind in ("name", "quoted") and self.peek("=", 1):
            raise outside("named paths")
        nodes, rels = [self.node()], []
        while self.peek("-") or self.peek("<"):
            rels.append(self.relationship())
            nodes.append(self.node())
        return A.Pattern(tuple(nodes), tuple(rels))

    def node(self) -> A.NodePattern:
        self.need("(")
        var = self.variable() if not (self.peek(")") or self.peek(":") or self.peek("{")) else None
        labels = []
        while self.op(":"):
            labels.append(self.key())
        props = self.map_items() if self.peek("{") else ()
        self.need(")")
        return A.NodePattern(var, tuple(labels), props)

    def relationship(self) -> A.RelPattern:
        inward = self.op("<")
        self.need("-")
        var, types, props, hops = None, [], (), None
        if self.op("["):
            if not (self.peek("]") or self.peek(":") or self.peek("{") or self.peek("*")):
                var = self.variable()
            if self.op(":"):
                types.append(self.key())
                while self.op("|"):
                    self.op(":")
                    types.append(self.key())
            if self.peek("*"):
                self.allowed("variable-length relationships")
                self.step()
                hops = self.hops()
            if self.peek("{"):
                props = self.map_items()
            self.need("]")
        self.need("-")
        outward = self.op(">")
        direction = "both" if inward == outward else "in" if inward else "out"
        return A.RelPattern(var, tuple(dict.fromkeys(types)), props, direction, hops)

    def hops(self) -> tuple[int, int | None]:
        low = self.step().value if self.now.kind == "int" else None
        if self.op(".."):
            return (1 if low is None else low), (self.step().value if self.now.kind == "int" else None)
        return (1, None) if low is None else (low, low)

    def map_items(self) -> tuple[tuple[str, A.Expr], ...]:
        self.need("{")
        if self.op("}"):
            return ()

        def entry():
            key = self.key()
            self.need(":")
            return key, self.expression()

        items = self.separated(entry)
        self.need("}")
        return items

    # -- expressions

    def infix(self) -> str:
        token = self.now
        if token.kind == "op":
            return token.text
        return token.word if token.kind == "name" else ""

    def expression(self, least: int = 0) -> A.Expr:
        left = self.prefix()
        while True:
            op = self.infix()
            power = POWERS.get(op)
            if power is None or power < least or power == least and op != "^" and least:
                return left
            self.step()
            if op == "IS":
                negated = self.word("NOT")
                self.need_word("NULL")
                left = A.IsNull(left, negated)
            elif op in ("STARTS", "ENDS"):
                self.need_word("WITH")
                left = A.Binary(f"{op} WITH", left, self.expression(power))
            elif op == "!=" or op in COMPARISONS:
                left = self.chain(left, "<>" if op == "!=" else op)
            else:
                left = A.Binary(op, left, self.expression(power + (op == "^")))

    def chain(self, left: A.Expr, op: str) -> A.Expr:
        """``a < b <= c`` is ``a < b AND b <= c``."""
        middle = self.expression(POWERS[op])
        out: A.Expr = A.Binary(op, left, middle)
        while self.infix() in (*COMPARISONS, "!="):
            op = self.step().text.replace("!=", "<>")
            right = self.expression(POWERS[op])
            out, middle = A.Binary("AND", out, A.Binary(op, middle, right)), right
        return out

    def prefix(self) -> A.Expr:
        if self.word("NOT"):
            return A.Unary("NOT", self.expression(NOT_POWER - 1))
        if self.op("-"):
            if self.now.kind == "int":
                value = self.step().value
                if value > LARGEST + 1:
                    raise QuerySyntaxError("IntegerOverflow")
                return self.postfix(A.Literal(-value)) if not self.peek("^") else A.Unary("-", A.Literal(value))
            if self.now.kind == "float":
                return self.postfix(A.Literal(-self.step().value))
            return A.Unary("-", self.expression(NEGATE_POWER))
        if self.op("+"):
            return self.expression(NEGATE_POWER)
        return self.postfix(self.primary())

    def postfix(self, base: A.Expr) -> A.Expr:
        while True:
            if self.peek(".") and self.ahead().kind in ("name", "quoted"):
                self.step()
                base = A.Prop(base, self.key())
            elif self.op("["):
                if self.op(".."):
                    high = None if self.peek("]") else self.expression()
                    base = A.Slice(base, None, high)
                else:
                    at = self.expression()
                    if self.op(".."):
                        base = A.Slice(base, at, None if self.peek("]") else self.expression())
                    else:
                        base = A.Index(base, at)
                self.need("]")
            elif self.peek(":") and isinstance(base, A.Var) and self.ahead().kind in ("name", "quoted"):
                labels = []
                while self.op(":"):
                    labels.append(self.key())
                base = A.HasLabels(base, tuple(labels))
            else:
                return base

    def primary(self) -> A.Expr:
        token = self.now
        if token.kind in ("int", "float", "string"):
            self.step()
            if token.kind == "int" and token.value > LARGEST:
                raise QuerySyntaxError("IntegerOverflow")
            return A.Literal(token.value)
        if token.kind == "param":
            self.step()
            return A.Param(str(token.value))
        if self.peek("["):
            return self.list_or_comprehension()
        if self.peek("{"):
            return A.MapOf(self.map_items())
        if self.peek("("):
            if self.extended and (found := self.pattern_predicate()):
                return found
            self.step()
            inner = self.expression()
            self.need(")")
            return inner
        if token.word == "CASE":
            return self.case()
        if token.word == "EXISTS" and self.peek("{", 1):
            return self.exists()
        if token.kind == "quoted" or token.kind == "name" and (token.word not in RESERVED or self.peek("(", 1) and token.word in ("ALL", "EXISTS")):
            return self.name_or_call()
        raise QuerySyntaxError(f"unexpected {token.text or 'end of query'!r}")

    def pattern_predicate(self) -> A.Expr | None:
        at, steps = self.at, self.steps
        try:
            pattern = self.pattern()
            if pattern.rels:
                return A.Exists((pattern,), None)
        except QuerySyntaxError:
            pass
        self.at, self.steps = at, steps
        return None

    def exists(self) -> A.Expr:
        self.allowed("EXISTS { ... }")
        self.step()
        self.need("{")
        self.word("MATCH")
        patterns = self.patterns()
        where = self.expression() if self.word("WHERE") else None
        self.need("}")
        return A.Exists(patterns, where)

    def name_or_call(self) -> A.Expr:
        token = self.step()
        name = str(token.value)
        if token.kind == "name" and token.text.lower() in ("true", "false", "null") and not self.peek("("):
            return A.Literal({"true": True, "false": False, "null": None}[token.text.lower()])
        while token.kind == "name" and name.split(".")[0].lower() in NAMESPACES and self.peek(".") and self.ahead().kind == "name" and self.peek("(", 2):
            self.step()
            name += "." + self.key()
        if not self.op("("):
            return A.Var(name)
        low = name.lower()
        if low in QUANTIFIERS and self.now.kind in ("name", "quoted") and self.ahead().word == "IN":
            var = self.variable()
            self.need_word("IN")
            source = self.expression()
            self.need_word("WHERE")
            test = self.expression()
            self.need(")")
            return A.Quantifier(low, var, source, test)
        if low == "reduce" and self.peek("=", 1):
            acc = self.variable()
            self.need("=")
            start = self.expression()
            self.need(",")
            var = self.variable()
            self.need_word("IN")
            source = self.expression()
            self.need("|")
            step = self.expression()
            self.need(")")
            return A.Reduce(acc, start, var, source, step)
        if self.op("*"):
            self.need(")")
            return A.Call(low, (), star=True)
        distinct = self.word("DISTINCT")
        args = () if self.peek(")") else self.separated(self.expression)
        self.need(")")
        return A.Call(low, args, distinct)

    def list_or_comprehension(self) -> A.Expr:
        self.need("[")
        if self.op("]"):
            return A.ListOf(())
        if self.now.kind in ("name", "quoted") and self.ahead().word == "IN" and self.comprehension_ahead():
            self.allowed("list comprehension")
            var = self.variable()
            self.step()
            source = self.expression()
            test = self.expression() if self.word("WHERE") else None
            out = self.expression() if self.op("|") else None
            self.need("]")
            return A.Comprehension(var, source, test, out)
        items = self.separated(self.expression)
        self.need("]")
        return A.ListOf(items)

    def comprehension_ahead(self) -> bool:
        """Whether this bracket holds WHERE or a bar at its own level (else it is a list of IN tests)."""
        depth, n = 0, 0
        while (t := self.ahead(n)).kind != "end":
            if t.kind == "op" and t.text in "([{":
                depth += 1
            elif t.kind == "op" and t.text in ")]}":
                if depth == 0:
                    return False
                depth -= 1
            elif depth == 0 and (t.text == "|" or t.word == "WHERE"):
                return True
            n += 1
        return False

    def case(self) -> A.Expr:
        self.step()
        subject = None if self.now.word == "WHEN" else self.expression()
        whens = []
        while self.word("WHEN"):
            test = self.expression()
            self.need_word("THEN")
            whens.append((test if subject is None else A.Binary("=", subject, test), self.expression()))
        default = self.expression() if self.word("ELSE") else None
        self.need_word("END")
        if not whens:
            raise QuerySyntaxError("CASE without WHEN")
        return A.Case(tuple(whens), default)


def parse(text: str, extended: bool = False) -> A.Query:
    return Parser(text, extended).parse()
