"""``python -m kinfold``: a whole run over a dataset folder."""

from kinfold.plans.job import main

raise SystemExit(main())
