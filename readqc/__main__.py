import sys

from readqc.cli import main

sys.exit(main())
