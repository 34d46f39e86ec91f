import sys

from gleanguard.cli import main

sys.exit(main())
