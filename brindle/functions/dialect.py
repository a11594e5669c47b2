"""Lexer and parser of the filter and projection dialect: text -> Node tree.

Loosest first: OR, AND, NOT, predicates, `+ - ||`, `* / %`, signs, and the postfix forms `x.y`, `x['y']`,
`x[1]` and `x::type`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class DialectError(ValueError):
    """The text isn't an expression of the dialect, or breaks a type rule."""


class Unsupported(DialectError, NotImplementedError):
    """A construct that the dialect refuses by name."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, name (quoted), string, number, hex, op, end
    text: str
    start: int
    stop: int


@dataclass
class Node:
    op: str
    args: list["Node"] = field(default_factory=list)
    value: object = None

    def walk(self):
        yield self
        for a in self.args:
            yield from a.walk()

    def columns(self) -> set[str]:
        return {n.value for n in self.walk() if n.op == "column"}


_LEX = re.compile(
    r"(?P<space>\s+)|(?P<hex>0[xX][0-9a-fA-F]+|[xX]'[0-9a-fA-F]*')|(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    r"|(?P<string>'(?:[^']|'')*')|(?P<name>\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`)|(?P<word>[^\W\d]\w*)"
    r"|(?P<op>::|\|\||<=|>=|<>|!=|==|[-+*/%<>=(),.\[\];])")


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise DialectError(f"unexpected character {text[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m.group(), at, m.end()))
        at = m.end()
    return out + [Token("end", "", len(text), len(text))]


def unquote(token: Token) -> str:
    if token.kind in ("name", "string"):
        q = token.text[0]
        return token.text[1:-1].replace(q + q, q)
    return token.text


_COMPARE = {"=": "=", "==": "=", "!=": "<>", "<>": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
#: pyarrow's function spellings of operators.
_SPELLED = {
    "add": "+", "add_checked": "+", "subtract": "-", "subtract_checked": "-", "multiply": "*", "multiply_checked": "*", "divide": "/", "divide_checked": "/",
    "equal": "=", "not_equal": "<>", "less": "<", "less_equal": "<=", "greater": ">", "greater_equal": ">=", "and_": "and", "and_kleene": "and", "or_": "or", "or_kleene": "or",
}
_REFUSED_WORDS = {"case": "CASE", "select": "a SELECT inside an expression", "exists": "EXISTS", "interval": "INTERVAL literals"}
_STOPS = {"and", "or", "not", "in", "between", "like", "ilike", "is", "as"}


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokens(text), 0

    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def next(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t.kind == "word" and t.text.lower() in words

    def take_word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += 1
            return True
        return False

    def take(self, op: str) -> bool:
        if self.peek().kind == "op" and self.peek().text == op:
            self.at += 1
            return True
        return False

    def expect(self, op: str) -> None:
        if not self.take(op):
            raise self.error(f"expected {op!r}")

    def error(self, what: str = "unexpected text") -> DialectError:
        t = self.peek()
        return DialectError(f"{what} at {t.start}: {t.text or 'the end'!r} in {self.text!r}")

    def whole(self) -> Node:
        if self.peek().kind == "end":
            raise DialectError("an empty expression")
        node = self.either()
        if self.peek().kind != "end":
            raise self.error()
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take_word("or"):
            node = Node("or", [node, self.both()])
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take_word("and"):
            node = Node("and", [node, self.negated()])
        return node

    def negated(self) -> Node:
        if self.take_word("not"):
            return Node("not", [self.negated()])
        return self.predicate()

    def predicate(self) -> Node:
        node = self.sum()
        while True:
            t = self.peek()
            if t.kind == "op" and t.text in _COMPARE:
                self.at += 1
                node = Node(_COMPARE[t.text], [node, self.sum()])
            elif self.take_word("is"):
                node = self.test(node)
            elif self.is_word("in", "between", "like", "ilike") or self.is_word("not") and self.is_word("in", "between", "like", "ilike", ahead=1):
                inverse = self.take_word("not")
                word = self.next().text.lower()
                node = getattr(self, f"_{word}")(node)
                node = Node("not", [node]) if inverse else node
            else:
                return node

    def test(self, node: Node) -> Node:
        inverse = self.take_word("not")
        if self.is_word("distinct"):
            raise Unsupported("IS DISTINCT FROM is not supported")
        for word in ("null", "true", "false"):
            if self.take_word(word):
                return Node(f"is_{'not_' * inverse}{word}", [node])
        raise self.error("expected NULL, TRUE or FALSE")

    def _in(self, node: Node) -> Node:
        self.expect("(")
        if self.is_word("select"):
            raise Unsupported("subqueries in IN are not supported")
        return Node("in", [node, *self.items(")")])

    def _between(self, node: Node) -> Node:
        low = self.sum()
        if not self.take_word("and"):
            raise self.error("expected AND")
        return Node("between", [node, low, self.sum()])

    def _like(self, node: Node, op: str = "like") -> Node:
        node = Node(op, [node, self.sum()])
        if self.is_word("escape"):
            raise Unsupported("ESCAPE is not supported")
        return node

    def _ilike(self, node: Node) -> Node:
        return self._like(node, "ilike")

    def sum(self) -> Node:
        node = self.product()
        while self.peek().kind == "op" and self.peek().text in ("+", "-", "||"):
            node = Node(self.next().text, [node, self.product()])
        return node

    def product(self) -> Node:
        node = self.signed()
        while self.peek().kind == "op" and self.peek().text in ("*", "/", "%"):
            node = Node(self.next().text, [node, self.signed()])
        return node

    def signed(self) -> Node:
        if self.take("-"):
            return Node("negate", [self.signed()])
        if self.take("+"):
            return self.signed()
        return self.postfix(self.atom())

    def postfix(self, node: Node) -> Node:
        while True:
            if self.take("::"):
                node = Node("cast", [node], self.type_name())
            elif self.peek().text == "[" and self.peek().kind == "op":
                self.at += 1
                index = self.either()
                self.expect("]")
                key = index.op == "literal" and isinstance(index.value, str)
                node = Node("field", [node], index.value) if key else Node("index", [node, index])
            elif node.op in ("column", "field") and self.take("."):
                t = self.next()
                if t.kind not in ("word", "name"):
                    raise self.error("expected a field name")
                node = Node("field", [node], unquote(t))
            else:
                return node

    def items(self, stop: str) -> list[Node]:
        out: list[Node] = []
        if self.take(stop):
            return out
        while True:
            out.append(self.either())
            if self.take(stop):
                return out
            self.expect(",")

    def type_name(self) -> str:
        t = self.next()
        if t.kind != "word":
            raise self.error("expected a type")
        name = t.text.lower()
        if name == "double" and self.take_word("precision"):
            pass
        if self.take("("):
            sizes = []
            while not self.take(")"):
                sizes.append(self.next().text)
                self.take(",")
            name += f"({','.join(sizes)})"
        return name

    def atom(self) -> Node:
        t = self.next()
        if t.kind == "number":
            exact = re.fullmatch(r"\d+", t.text)
            return Node("literal", value=int(t.text) if exact else float(t.text))
        if t.kind == "string":
            return Node("literal", value=unquote(t))
        if t.kind == "hex":
            digits = t.text[2:].rstrip("'")
            if len(digits) % 2:
                raise DialectError(f"a hex literal needs an even number of digits: {t.text}")
            return Node("literal", value=bytes.fromhex(digits))
        if t.kind == "name":
            return Node("column", value=unquote(t))
        if t.kind == "op" and t.text == "(":
            node = self.either()
            self.expect(")")
            return node
        if t.kind == "op" and t.text == "[":
            return Node("list", self.items("]"))
        if t.kind != "word":
            self.at -= 1
            raise self.error()
        low = t.text.lower()
        if low in ("true", "false", "null"):
            return Node("literal", value={"true": True, "false": False, "null": None}[low])
        if low in ("date", "timestamp") and self.peek().kind == "string":
            return Node(low, value=unquote(self.next()))
        if low == "array" and self.take("["):
            return Node("list", self.items("]"))
        if low in _REFUSED_WORDS and (low != "interval" or self.peek().kind == "string"):
            raise Unsupported(f"{_REFUSED_WORDS[low]} is not supported")
        if low == "cast" and self.take("("):
            node = self.either()
            if not self.take_word("as"):
                raise self.error("expected AS")
            node = Node("cast", [node], self.type_name())
            self.expect(")")
            return node
        if self.take("("):
            args = self.items(")")
            if low == "arrow_cast":
                if len(args) != 2 or args[1].op != "literal":
                    raise DialectError("arrow_cast takes a value and a type in quotes")
                return Node("cast", args[:1], str(args[1].value).lower())
            if low in _SPELLED and len(args) == 2:
                return Node(_SPELLED[low], args)
            if low == "negate" and len(args) == 1:
                return Node("negate", args)
            return Node("call", args, low)
        if low in ("current_date", "current_timestamp"):
            return Node("call", [], low)
        if low in _STOPS:
            self.at -= 1
            raise self.error()
        return Node("column", value=t.text)


def parse(text: str) -> Node:
    return Parser(text).whole()
