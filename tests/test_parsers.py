from __future__ import annotations

from loomdex.operators.parsers import parse_go, parse_python, parse_typescript


def names(found):
    return [(d.kind, d.name) for d in found]


def spans(found):
    return [(d.kind, d.name, d.start, d.end) for d in found]


def test_python():
    text = "import os\nfrom a import (\n    b)\nclass Store:\n    def __init__(self):\n        self.x = {'a': '}'}\n\n    def read(self):\n        return '''\ndef no(): pass\n'''\n\n@wrap\nasync def build[T](x: T) -> T:\n    def inner():\n        pass\n    return x\n"
    assert spans(parse_python(text)) == [("import", "imports", 1, 3), ("class", "Store", 4, 11), ("method", "__init__", 5, 6), ("method", "read", 8, 11), ("function", "build", 13, 17)]


def test_python_without_declarations():
    assert parse_python("x = 1\n") == []


def test_go():
    text = 'package m\n\nimport (\n\t"fmt"\n\tx "os"\n)\n\ntype Handler struct {\n\tname string\n}\n\nfunc New[T any](n string) *Handler {\n\treturn &Handler{name: "}"}\n}\n\nfunc (h *Handler) Serve(f func(int) interface{}) string {\n\treturn `}`\n}\n\ntype (\n\tA int\n\tB struct {\n\t\tc int\n\t}\n)\n'
    assert spans(parse_go(text)) == [("import", "imports", 3, 6), ("class", "Handler", 8, 10), ("function", "New", 12, 14), ("method", "Serve", 16, 18), ("class", "A", 21, 21), ("class", "B", 22, 24)]


def test_typescript():
    text = """import a from 'a';
import { b } from "b";

/** Doc. */
export interface Shape { area(): number }
type Id = string | number;
export enum Color { Red }
namespace Geo { export function dist(a: number): number { return a; } }
export const add = (a: number, b: number) => a + b;
export const wrapped = memo(() => { return 1; });
export const limit = 10;
export const { x, y } = point;
const hidden = 1;
declare function ambient(): void;
export abstract class Base<T extends object> implements Shape {
  constructor(private n: number) { super(); }
  get size(): number { return 1; }
  set size(v: number) { this.n = v; }
  abstract later(): void;
  over(a: string): void;
  over(a: any): { b: number } { return { b: `}${a}` }; }
  area = () => 3;
  async *gen() { yield 1; }
}
export default function () { return 0; }
"""
    assert names(parse_typescript(text)) == [
        ("import", "imports"), ("interface", "Shape"), ("typeAlias", "Id"), ("enum", "Color"), ("namespace", "Geo"), ("function", "dist"), ("function", "add"), ("function", "wrapped"), ("variable", "limit"),
        ("class", "Base"), ("constructor", "constructor"), ("method", "get size"), ("method", "set size"), ("method", "over"), ("method", "gen"), ("function", "default"),
    ]
    assert spans(parse_typescript(text))[1][2:] == (4, 5)
