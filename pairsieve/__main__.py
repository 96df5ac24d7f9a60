from pairsieve.cli import main

main()
