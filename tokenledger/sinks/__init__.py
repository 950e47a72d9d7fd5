"""Writers: fact exports, report files and bounded JSON documents."""
