"""Entry script for spark-submit."""

from pairsieve.cli import main

if __name__ == "__main__":
    main()
