import sys

from quadflow.cli import main

sys.exit(main())
