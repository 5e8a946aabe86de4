import sys

from pagerecs.cli import main

sys.exit(main())
