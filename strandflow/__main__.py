from strandflow.cli import main

main()
