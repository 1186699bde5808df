"""python -m geoweave TOOL FILE... option=value..."""

from __future__ import annotations

import ast
import sys


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    from geoweave.plans.tools import TOOLS

    if not args or args[0] not in TOOLS:
        print(__doc__, "tools:", *TOOLS)
        return 2

    def value(text: str):
        try:
            return ast.literal_eval(text.capitalize() if text.lower() in ("true", "false", "none") else text)
        except (ValueError, SyntaxError):
            return text

    named = {a.split("=", 1)[0]: value(a.split("=", 1)[1]) for a in args[1:] if "=" in a}
    if "octree" in named:
        named["octree_"] = named.pop("octree")
    TOOLS[args[0]](SparkSession.builder.getOrCreate(), *(value(a) for a in args[1:] if "=" not in a), **named)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
