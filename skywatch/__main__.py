import sys

from skywatch.cli import main

sys.exit(main())
