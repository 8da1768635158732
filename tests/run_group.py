"""Compare the queries of one group only: python -m tests.run_group ROOT GROUP..."""

import sys

from tests import compare


def main(argv):
    sys.path.insert(0, ".")
    import re

    names = []
    for group in argv[1:]:
        with open(f"agorasift/plans/{group}.py", encoding="utf-8") as source:
            names += [re.sub(r"\{.*", "*", n) for n in re.findall(r'query\(f?"([^"]+)"', source.read())]
    return compare.main([argv[0], *names])


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
