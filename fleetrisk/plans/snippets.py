"""Lines the derived fleets are made of: shapes that rules should and should not report.

A derived file is a run of these lines picked by arithmetic on a table key, so its number
and content follow the driver's tables.
"""

JS = [
    "const r = await fetch(req.query.url)",
    "const ok = await fetch('https://api.example.com/v1')",
    "db.query(\"SELECT * FROM t WHERE id=\" + id)",
    "db.query(`SELECT name FROM users WHERE id = ${id}`)",
    "db.query('SELECT 1', [id])",
    "exec(`ls ${dir}`)",
    "el.innerHTML = payload;",
    "el.innerHTML = '<b>hi</b>';",
    "<div dangerouslySetInnerHTML={{__html: body}} />",
    "document.write(value)",
    "eval(input)",
    "eval('1+1')",
    "const f = new Function(src)",
    "fs.readFile(base + req.params.name, cb)",
    "const h = crypto.createHash('md5').update(password)",
    "const t = Math.random().toString(36) // token",
    "jwt.verify(tok, key, { algorithms: ['none'] })",
    "const who = jwt.decode(tok).user",
    "app.use(cors({ origin: '*', credentials: true }))",
    "res.redirect(req.query.next)",
    "const agent = new Agent({ rejectUnauthorized: false })",
    "res.cookie('sid', v, { httpOnly: false })",
    "session({ cookie: { secure: false } })",
    "bcrypt.hash(pw, 4, cb)",
    "const k = process.env.KEY || \"sk_live_abcdefghijklmnop1234\"",
    "const p = process.env.NEXT_PUBLIC_API_KEY",
    "// eval(commentedOut)",
    "  { regex: /eval(x)/, name: 'x' },",
    "const rx = /new Function(/g;",
    "User.create(req.body)",
    "const m = new Account(req.body)",
    "user.role = req.body.role",
    "charge({ amount: req.body.amount })",
    "logger.info({ amount: req.body.amount })",
    "const o = await Order.findById(req.params.id)",
    "const API_KEY = \"your-api-key\"",
    "// TODO: validate the user before saving",
    "// this is a simplified example",
    "try { run() } catch (e) {}",
    "label: 'insert_your_api_key_here',",
    "app.use(cors())",
    "app.enableCors()",
    "return total * 2",
    "",
]

PY = [
    "r = requests.get(request.args['u'])",
    "urllib.request.urlopen(params['u'])",
    "cur.execute(f\"SELECT * FROM t WHERE id={x}\")",
    "cur.execute(\"DELETE FROM t WHERE id=%s\" % x)",
    "cur.execute('SELECT 1', (x,))",
    "subprocess.run(cmd, shell=True, cwd=f'{d}')",
    "os.system(f'rm {p}')",
    "exec(code)",
    "eval('2')",
    "open(request.files['f'])",
    "hashlib.md5(password.encode())",
    "t = random.randint(0, 9)  # session token",
    "obj = pickle.loads(blob)",
    "cfg = yaml.load(fh)",
    "cfg = yaml.load(fh, Loader=yaml.SafeLoader)",
    "requests.post(u, verify=False)",
    "# eval(x)",
    "User.objects.create(**request.data)",
    "is_staff = request.POST",
    "amount = request.data",
    "Order.objects.get(pk=request.GET['id'])",
    "try: go()",
    "except Exception: pass",
    "DEBUG = True",
    "ALLOWED_HOSTS = ['*']",
    "@csrf_exempt",
    "app.run(host='0.0.0.0', debug=True)",
    "allow_origins=['*'],",
    "# FIXME add authentication here",
    "password = 'change-me'",
    "value = compute(1)",
    "",
]

OTHER_CODE = [
    "http.csrf().disable()",
    "@CrossOrigin(origins = \"*\")",
    "management.endpoints.web.exposure.include=*",
    "'debug' => true,",
    "skip_before_action :verify_authenticity_token",
    "// in a real application you would check this",
    "int x = 1;",
]

DOCKER = [
    "FROM node:14-alpine AS build",
    "FROM build",
    "FROM python:3.7",
    "FROM ubuntu",
    "FROM registry.local:5000/team/ruby:2.7",
    "FROM --platform=linux/amd64 debian:buster-slim",
    "FROM alpine:latest",
    "FROM golang:1.22",
    "FROM scratch",
    "FROM centos:7",
    "USER root",
    "USER node",
    "ADD https://example.com/x.tgz /x",
    "ENV API_KEY=abc123",
    "RUN curl -s https://x.sh | bash",
    "RUN chmod -R 777 /app",
    "RUN apt-get install -y curl",
    "RUN apt-get install -y curl=7.1",
    "COPY . .",
    "RUN echo ok",
]

WORKFLOW = [
    "on:\n  pull_request_target:",
    "on: push",
    "  - uses: actions/checkout@v4",
    "    with:\n      ref: ${{ github.event.pull_request.head.sha }}",
    "      ref: ${{ github.head_ref }}",
    "  - uses: someone/tool@main",
    "  - uses: someone/tool@0123456789abcdef0123456789abcdef01234567",
    "  - uses: docker/login-action@v3",
    "  - name: step",
    "    run: |",
    "      echo ${{ github.event.issue.title }}",
    "  - run: echo ${{ github.head_ref }}",
    "permissions: write-all",
    "    permissions: write-all",
    "permissions:\n  contents: read",
    "  API_TOKEN: abcdef123456",
    "  API_TOKEN: ${{ secrets.API_TOKEN }}",
    "  TOKEN_EXPIRY: 3600",
    "  DB_PASSWORD: \"hunter2hunter2\"",
    "  SECRET_ENABLED: true",
    "jobs:",
]

TERRAFORM = [
    "resource \"aws_s3_bucket\" \"b\" {",
    "  acl = \"public-read\"",
    "  acl = \"private\"",
    "  block_public_acls = false",
    "  Action = \"*\"",
    "  actions = [\"*\"]",
    "  Resource = [\"*\"]",
    "  resources = [ \"*\" ]",
    "  storage_encrypted = false",
    "  publicly_accessible = true",
    "  ingress {",
    "    cidr_blocks = [\"0.0.0.0/0\"]",
    "    ipv6_cidr_blocks = [\"::/0\"]",
    "    cidr_blocks = [\"10.0.0.0/8\"]",
    "  }",
    "  egress {",
    "}",
    "  ingress = [{ cidr_blocks = [\"0.0.0.0/0\"] }]",
]

CLOUDFORMATION = [
    "AWSTemplateFormatVersion: '2010-09-09'",
    "Resources:",
    "  Type: AWS::S3::Bucket",
    "  AccessControl: PublicRead",
    "  BlockPublicAcls: false",
    "  Action: \"*\"",
    "  - \"*\"",
    "  Resource: \"*\"",
    "  StorageEncrypted: false",
    "  PubliclyAccessible: true",
    "  SecurityGroupIngress:",
    "  SecurityGroupEgress:",
    "    CidrIp: 0.0.0.0/0",
    "    CidrIpv6: ::/0",
    "    CidrIp: 10.0.0.0/8",
]

KUBERNETES = [
    "apiVersion: v1",
    "kind: Pod",
    "  privileged: true",
    "  hostNetwork: true",
    "  allowPrivilegeEscalation: true",
    "  runAsUser: 0",
    "  runAsNonRoot: false",
    "  - image: nginx",
    "    image: registry:5000/app:latest",
    "    image: app@sha256:aaaa",
    "    image: app:1.2",
    "    privileged: {{ .Values.priv }}",
    "      add: [\"SYS_ADMIN\"]",
    "      add:",
    "        - NET_ADMIN",
    "        - CHOWN",
    "      drop:",
    "        - ALL",
    "",
]

HELM = [
    "privileged: true",
    "runAsNonRoot: false",
    "runAsUser: 0",
    "hostPID: true",
    "allowPrivilegeEscalation: true",
    "  tag: latest",
    "  tag: \"\"",
    "  tag: 1.2.3",
    "replicas: 2",
]

IAM_POLICY = [
    "{\"Statement\": [{\"Effect\": \"Allow\",",
    "  \"Action\": \"*\",",
    "  \"Action\": [\"s3:*\"],",
    "  \"Action\": \"s3:GetObject\",",
    "  \"Resource\": \"*\",",
    "  \"Principal\": {\"AWS\": \"*\"},",
    "role: roles/owner",
    "\"role\": \"roles/editor\"",
    "roleDefinitionName: Owner",
    "role: Contributor",
    "id: 8e3af657-a8ff-443c-a75c-2fe8c4bcb635",
    "id: b24988ac-6180-42a0-ab88-20f7382dd24c",
    "\"Actions\": [\"*\"],",
    "scopes: repo admin:org",
    "gh auth login --scopes \"delete_repo\"",
    "note: nothing here",
]

SENSITIVE_PATHS = [
    ("keys/server", ".pem"), ("keys/public", "-pub.pem"), ("a", "/private.asc"), ("a", "/release.tar.gz.asc"),
    ("store", ".p12"), ("home", "/.ssh/id_rsa"), ("vault", ".kdbx"), ("", ".env.production"), ("app", "/.env"),
    ("app", "/.env.example"), ("u", "/.aws/credentials"), ("proj", "-0123456789ab.json"), ("x", "/.kube/config"),
    ("x", "/kubeconfig.yaml"), ("d", "/.docker/config.json"), ("n", "/.npmrc"), ("p", "/.pypirc"),
    ("t", "/terraform.tfstate"), ("dump", ".sql"), ("db/migrations/m", ".sql"), ("v1_", "_init.sql"), ("old", ".bak"),
    ("g", "/.git-credentials"), ("h", "/.htpasswd"), ("q", "/.pgpass"), ("node_modules/k", "/id_rsa"),
    ("src/app", ".ts"), ("README", ".md"),
]

SCAN_PATHS = [
    ("src/f", ".ts"), ("lib/f", ".py"), ("tests/f", ".js"), ("docs/f", ".md"), ("node_modules/f", "/x.js"),
    (".github/workflows/f", ".yml"), ("f", ".lock"), ("bin/f", ""), ("d", "/Dockerfile"), ("e", "/.env.local"),
    ("routes/f", ".js"), ("pkg/f", "_test.go"), ("a.b/f", ""), ("img/f", ".png"), ("app/x/f", "/route.ts"),
    ("dist/f", ".js"), ("web/f", ".min.js"), ("api/f", ".controller.ts"), ("pages/api/f", ".ts"), ("f", ".tf"),
]
