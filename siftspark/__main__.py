"""python -m siftspark"""

from siftspark.cli import main

raise SystemExit(main())
