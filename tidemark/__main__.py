from tidemark.plans.jobs import main

main()
