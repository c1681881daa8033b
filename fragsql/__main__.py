import sys

from fragsql.plans.cli import main

sys.exit(main())
