"""Small source files in seven languages, and an index of them, for queries on extraction, skeletons and lookups."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

from ..sources import files as sources

SOURCES = {
    "src/stack.rs": """use std::collections::HashMap;

/// A stack
pub struct Stack {
    items: Vec<i64>,
}

impl Stack {
    pub fn push(&mut self, x: i64) {
        check(x);
        self.items.push(x);
    }
}

fn check(x: i64) -> bool {
    x > 0
}
""",
    "app/bank.py": """import json
from .util import fmt as f

class Account(Base):
    \"\"\"Money of one owner.\"\"\"
    limit = 10

    def pay(self, n):
        return f(n)

def test_pay():
    a = Account()
    a.pay(3)

test_pay()
""",
    "web/cart.js": """import part from './part.js';
class Cart extends Base {
  add(item) {
    note(item);
  }
}
const total = (xs) => {
  return sum(xs);
};
function main() {
  total([1]);
}
""",
    "web/shape.ts": """interface Shape {
  name: string;
}
enum Kind { Round, Flat }
class Disc implements Shape {
  name: string;
  area(): number {
    return square(this.name);
  }
}
""",
    "srv/main.go": """package srv

import (
\t"fmt"
)

type Pair struct {
\tA int
\tB int
}

func (p Pair) Sum() int {
\treturn add(p.A, p.B)
}

func add(a int, b int) int {
\treturn a + b
}
""",
    "j/Box.java": """package j;
import java.util.List;
public class Box {
  private int size;
  public Box(int size) {
    this.size = size;
  }
  int twice() {
    return scale(size);
  }
}
""",
    "c/ring.cpp": """#include <vector>
namespace geo {
class Ring : public Shape {
public:
  int width;
  int area() {
    return mul(width);
  }
};
}
int main() {
  return 0;
}
""",
    "web/broken.js": """function whole() {
  fine(1);
}
function half( {
  lost(2);
""",
    "app/broken.py": """def good():
    return one(1)

def bad(:
    two(2)
""",
}


def files_of(spark: SparkSession) -> DataFrame:
    return sources.files_from_rows(spark, list(SOURCES.items()))


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: under spark.checkpoint.dir, or temporary in local mode."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparkloom-", dir=os.environ.get("TMPDIR"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


_INDEXES: dict[str, str] = {}


def index_of(spark: SparkSession):
    """An index of the sources, built once an application."""
    from . import api

    key = spark.sparkContext.applicationId
    if key not in _INDEXES:
        out = folder(spark, "fixture-index")
        api.build_index(spark, files_of(spark), out)
        _INDEXES[key] = out
    return api.Index(spark, _INDEXES[key])
