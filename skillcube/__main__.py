from skillcube.plans.verbs import main

main()
