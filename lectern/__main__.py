import sys

from lectern.cli import main

sys.exit(main())
