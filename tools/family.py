"""Check one family of queries: python tools/family.py reports [more]"""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import check  # noqa: E402
from barsift import plans  # noqa: E402
from barsift.plans import registry  # noqa: E402

plans.load()
wanted = tuple(f"plans.{a}" for a in sys.argv[1:])
names = [n for n, f in registry.QUERIES.items() if f.__module__.endswith(wanted)]
sys.argv = ["check", *names]
sys.exit(check.main())
