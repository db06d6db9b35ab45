import sys

from concordat.plans.cli import main

sys.exit(main())
