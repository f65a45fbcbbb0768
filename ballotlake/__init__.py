"""ballotlake: roll-call and member x event analytics expressed as Spark plans."""
